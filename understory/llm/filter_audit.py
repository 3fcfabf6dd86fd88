"""How filters act together in every order, by wide packed counters."""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from understory.llm.text import pick, ready, text_runs
from understory.session import stored

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = [(order, step) for order in ORDERS for step in range(1, len(FILTERS) + 1)]
BANKS = ("removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: Bits of one field. A field counts rows of a part, which is less than 2**63, so no sum runs over into the next.
FIELD_BITS = 64
DUPLICATE = 1 << FILTERS.index("E")

_CAPITALS, _MARKS = bytes(range(65, 91)), b"#$%&*|"
_LEADING = bytes(b for b in range(256) if b & 0xC0 != 0x80)  # the first byte of each code point


def outcomes(mask: int) -> dict[str, int]:
    """Per bank, the big integer whose field s is 1 if a document that fails `mask` counts at step s."""
    packed = dict.fromkeys(("removed", "redundant", "unique_fails"), 0)
    for place, (order, step) in enumerate(STEPS):
        mine = 1 << FILTERS.index(order[step - 1])
        earlier = sum(1 << FILTERS.index(x) for x in order[:step - 1])
        if mask & mine:
            packed["redundant" if mask & earlier else "removed"] |= 1 << FIELD_BITS * place
            if mask == mine:
                packed["unique_fails"] |= 1 << FIELD_BITS * place
    return packed


def wide_counter(mask: int, good: bool, toxic: bool) -> int:
    """All banks of one document in one integer, bank after bank."""
    of = outcomes(mask)
    of |= {"good_lost": of["removed"] if good else 0, "toxic_lost": of["removed"] if toxic else 0}
    return sum(of[bank] << FIELD_BITS * len(STEPS) * k for k, bank in enumerate(BANKS))


def unpacked(total: int) -> np.ndarray:
    """Fields of a summed counter: one row per bank, one column per step of an order."""
    width = FIELD_BITS // 8 * len(STEPS) * len(BANKS)
    return np.frombuffer(total.to_bytes(width, "little"), "<u8").astype(np.int64).reshape(len(BANKS), len(STEPS))


def text_mask(text: bytes) -> int:
    """Which of the filters A to D a text fails: few words, repeated words, capitals, marks."""
    words = text.split()  # of bytes: at space and \\x09-\\x0D only
    points = len(text) - len(text.translate(None, _LEADING)) if not text.isascii() else len(text)
    fails = (len(words) < 100, 100 * len(set(words)) < 80 * len(words),
             100 * (len(text) - len(text.translate(None, _CAPITALS))) > 10 * points,
             len(text.translate(None, _MARKS)) < len(text))
    return sum(1 << k for k, failed in enumerate(fails) if failed)


def _judge(batches):
    for batch in batches:
        for start, end, texts in text_runs(batch["text"]):
            masks, digests = [], []
            for text in texts.cast(pa.binary()).to_pylist():
                masks.append(text_mask(text))
                digests.append(hashlib.sha256(text).digest())
            rows = batch.slice(start, end - start)
            yield pa.RecordBatch.from_arrays([rows["id"], rows["part"], pa.array(masks, pa.int32()), pa.array(digests, pa.binary())],
                                             names=["id", "part", "mask", "digest"])


def _sum_parts(batches):
    """Sum the wide counters of each part; rows come sorted by part, a part has at most one row per mask and label."""
    known, part, total, rows = {}, None, 0, 0

    def report():
        fields = unpacked(total)
        removed = fields[0].reshape(len(ORDERS), len(FILTERS))
        shapley = {f: int(sum(removed[n, order.index(f)] for n, order in enumerate(ORDERS))) for f in FILTERS}
        left = (rows - np.cumsum(removed, axis=1)).ravel()
        return pa.RecordBatch.from_arrays(
            [pa.array([part] * len(STEPS)), pa.array([o for o, _ in STEPS]), pa.array([s for _, s in STEPS], pa.int32()), pa.array(left),
             *[pa.array(f) for f in fields], pa.array([shapley[o[s - 1]] for o, s in STEPS], pa.int64())],
            names=["part", "filter_order", "step", "kept", *BANKS, "shapley"])

    for batch in batches:
        for value, mask, good, toxic, n in zip(*(batch[c].to_pylist() for c in ("part", "mask", "good", "toxic", "n"))):
            if value != part:
                if part is not None:
                    yield report()
                part, total, rows = value, 0, 0
            kind = (mask, good, toxic)
            if kind not in known:
                known[kind] = wide_counter(*kind)
            total += n * known[kind]
            rows += n
    if part is not None:
        yield report()


def audit_filters(documents: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost (rows of the part), and shapley, the removals of the step's filter summed over all orders.

    Filters: A under 100 words; B under 80 % distinct words; C over 10 % capitals A-Z; D one of `#$%&*|`; E the text of a
    smaller id, anywhere in the table. A document's failures are a mask of five bits; a mask has an integer of 3,000 fields
    of 64 bits, one for each bank and step; a part's rows are the sum of their integers.

    Equal texts meet by SHA-256 in aggregates only: the first id of each text is a minimum, so a text with a third of all
    rows is one row per task before the shuffle. Rows are counted by part, mask and label (128 kinds) before the sums.

    NULL text is empty, a NULL part is the empty string. A NULL id is smaller than none and has no smaller one but those
    that are not NULL; it has no labels. Rows that share an id and text are each counted; several label rows of one id count
    as their maximum. Other columns are left out, clashing or not. An empty table gives no rows.
    """
    ready(documents.sparkSession)
    rows = pick(documents, id=id_col, text=text_col, part=part_col).select(
        F.col("id").cast("bigint").alias("id"), "text", F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"))
    judged = rows.mapInArrow(_judge, "id bigint, part string, mask int, digest binary")
    counted = judged.groupBy("digest", "id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = (pick(labels, label_id=id_col, quality="quality", toxic="toxic").groupBy(F.col("label_id").cast("bigint").alias("label_id"))
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    found = counted.join(marks, F.col("id") == F.col("label_id"), "left").select(
        "digest", "id", "part", "mask", "n", *[(F.coalesce(c, F.lit(0)) == 1).alias(c) for c in ("good", "toxic")])
    found = stored(found, "audit")

    # the smallest id of each text: NULL counts as the largest, so that it repeats all others and none repeats it
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"))
    per_part = found.groupBy("digest", "part").agg(
        F.min(F.struct(order.alias("order"), F.col("n"), F.col("mask"), F.col("good"), F.col("toxic"))).alias("first"))
    least = F.min("first.order").over(Window.partitionBy("digest"))  # one row per text and part
    first = (per_part.withColumn("least", least).filter(F.col("first.order").eqNullSafe(F.col("least")))
             .select("part", "first.mask", "first.good", "first.toxic", "first.n"))
    kinds = ["part", "mask", "good", "toxic"]
    # E fails for all rows but the first of each text
    repeats = (found.select(*kinds, F.col("n")).unionByName(first.withColumn("n", -F.col("n")))
               .withColumn("mask", F.col("mask").bitwiseOR(F.lit(DUPLICATE))))
    tally = repeats.unionByName(first).groupBy(*kinds).agg(F.sum("n").alias("n"))
    return (tally.repartition("part").sortWithinPartitions("part")
            .mapInArrow(_sum_parts, "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
                                    "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"))
