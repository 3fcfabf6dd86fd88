"""Exact Jaccard join of shingle sets in a metric space, and the components of its links.

The Jaccard distance is a metric. Sets at random are at distance 1 from each other, so pivots taken from a sample would
tell nothing apart; here each set finds its pivots by a shared shingle. Of two sets within the radius, the rarest
quarter of the shingles of either holds one of the other's (the prefix bound), so each shingle, as a rare one, makes a
cell of sets, and the cell's pivot is its smallest set. All sets with one pivot are its region; a set near a border lies
in the regions of all pivots of its rare shingles. Every set is compared with its pivots. Those within the radius join
the pivot's component at once. Where many members of a large region are outside, the members nearest to the pivot
become pivots themselves, again and again. Of what is left, only pairs of different components whose distances to the
region's pivot differ by no more than the radius (the triangle inequality) are compared, and only where sizes and
signatures (counts of shingles in classes, whose difference bounds the symmetric difference from below) allow a link.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from understory.llm.text import RUN_BYTES, SpanHasher, kept, mixed, pick, ready, run_hash, text_runs, utf8, word_spans
from understory.session import scratch_path, stored

SHINGLE = 5
#: Shingles that are ordered last because many sets hold them; their number bounds what is broadcast.
FREQUENT = 1 << 18
#: Shingles are counted in spans of so many, and a span passes on what at least LOCAL_COUNT (2 or more) of its sets share.
SPAN, LOCAL_COUNT = 1 << 22, 2
#: Cells of every so many shingles also take these further sets as pivots, so that groups of near copies meet early.
MORE_PIVOTS, MORE_EVERY = 3, 16
#: Regions in which more pairs than this are open take further pivots, so many in each round.
CROWD, ROUND_PIVOTS = 1 << 12, 4
#: A signature has BINS classes. Counts of many shingles a class are alike by chance, so a large set has a fine one too, with a
#: class per PER_BIN shingles (a power of two, at most MOST_BINS): only pairs of sets that are open already meet by that.
PER_BIN, BINS, MOST_BINS = 4, 128, 4096
_WORD = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
_U = np.uint64


class Sets:
    """Shingle sets of a run of texts: sorted distinct hashes laid one after another, and a key of each whole set."""

    def __init__(self, texts: pa.Array):
        data, offsets = utf8(texts)
        starts, ends, first = word_spans(data, offsets, _WORD)
        words, n = SpanHasher(data, lower=True)(starts, ends), np.diff(first)
        owner = np.repeat(np.arange(len(n)), n)
        gram = run_hash(words, SHINGLE)
        whole = owner[:len(gram)] == owner[SHINGLE - 1:] if len(gram) else np.zeros(0, bool)
        hashes, owners = [gram[whole]], [owner[:len(gram)][whole]]
        for k in range(1, SHINGLE):  # fewer words: the whole sequence is the only shingle
            short = np.flatnonzero(n == k)
            if len(short):
                at = first[short]
                part = np.zeros(len(short), np.uint64)
                for j in range(k):
                    part = part * _U(0xD6E8FEB86659FD93) + words[at + j]
                hashes.append(mixed(part + _U(k)))
                owners.append(short)
        h, o = np.concatenate(hashes), np.concatenate(owners)
        if len(hashes) > 1:
            order = np.argsort(o, kind="stable")
            h, o = h[order], o[order]
        ends = np.cumsum(np.bincount(o, minlength=len(n))).tolist()
        for a, b in zip([0, *ends], ends):  # short sorts: several times faster than one by two keys
            if b - a > 1:
                h[a:b].sort()
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        self.hashes, self.owner = h[new], o[new]
        self.sizes = np.bincount(self.owner, minlength=len(n))
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes)])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(self.hashes ^ _U(0x5851F42D4C957F2D)), dtype=np.uint64)])
        self.keys = mixed(sums[self.bounds[1:]] - sums[self.bounds[:-1]] + self.sizes.astype(np.uint64)).view(np.int64)

    def distinct(self) -> np.ndarray:
        """The first of each equal set of the run, empty ones left out."""
        full = np.flatnonzero(self.sizes > 0)
        return full[np.sort(np.unique(self.keys[full], return_index=True)[1])]

    def rarest(self, some: np.ndarray, common: np.ndarray, times: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """For some sets, places of the shingles one of which any set that links holds; which are common (sorted, in so many sets)."""
        keep = np.zeros(len(self.sizes), bool)
        keep[some] = True
        at = np.flatnonzero(keep[self.owner])
        count = np.zeros(len(at), np.int64)
        if len(common):
            leading = np.zeros(1 << 22, bool)  # of common shingles: most others are told by it
            leading[common >> _U(42)] = True
            maybe = np.flatnonzero(leading[self.hashes[at] >> _U(42)])
            h = self.hashes[at[maybe]]
            place = np.minimum(np.searchsorted(common, h), len(common) - 1)
            count[maybe] = np.where(common[place] == h, times[place], 0)
        # in each set by count, then hash; those that aren't common stand in order already
        limit = self.sizes + 1 + (-percent * self.sizes) // 100
        first, last = at[count == 0], at[count > 0]
        last = last[np.lexsort((count[count > 0], self.owner[last]))]
        n_first = np.bincount(self.owner[first], minlength=len(self.sizes))
        n_last = np.bincount(self.owner[last], minlength=len(self.sizes))
        one, two = self.owner[first], self.owner[last]
        first = first[np.arange(len(first)) - (np.cumsum(n_first) - n_first)[one] < limit[one]]
        last = last[np.arange(len(last)) - (np.cumsum(n_last) - n_last)[two] + n_first[two] < limit[two]]
        return np.concatenate([first, last]), np.repeat([False, True], [len(first), len(last)])


def distinct_columns(rows: np.ndarray) -> np.ndarray:
    """The columns of a table of whole numbers without repeats (but for chance ones of their hashes), in another order."""
    key = np.zeros(rows.shape[1], np.uint64)
    for row in rows:
        key = key * _U(0xD6E8FEB86659FD93) + row.view(np.uint64)
    rows = rows[:, np.argsort(key)]
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[:, 1:] != rows[:, :-1]).any(0)
    return rows[:, new]


def _runs(batches, column: int):
    kept("shingles")
    for batch in batches:
        for start, end, texts in text_runs(batch.column(column)):
            yield batch.slice(start, end - start), texts, Sets(texts)


def frequent_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The FREQUENT commonest shingles, sorted, and their counts, over all texts.

    The sums order shingles, so that passages many sets share come last; no result depends on them.
    """
    def counted(span):
        span.sort()
        again = np.zeros(len(span) + 1, bool)  # equal to the one before
        np.equal(span[1:], span[:-1], out=again[1:-1])
        first, last = np.flatnonzero(~again[:-1] & again[1:]), np.flatnonzero(again[:-1] & ~again[1:])
        times = last - first + 1
        some = times >= LOCAL_COUNT
        return pa.RecordBatch.from_arrays([pa.array(span[first[some]].view(np.int64)), pa.array(times[some], pa.int64())], names=["s", "times"])

    def count(batches):
        span, size = np.empty(SPAN, np.uint64), 0  # the only copy: it is filled and sorted in place
        for _, _, s in _runs(batches, 0):
            keep = np.zeros(len(s.sizes), bool)
            keep[s.distinct()] = True
            new = s.hashes[keep[s.owner]]
            while len(new):
                n = min(len(new), SPAN - size)
                span[size:size + n] = new[:n]
                new, size = new[n:], size + n
                if size == SPAN:
                    yield counted(span)
                    size = 0
        if size:
            yield counted(span[:size])

    top = (texts.mapInArrow(count, "s bigint, times bigint").groupBy("s").agg(F.sum("times").alias("times"))
           .orderBy(F.col("times").desc(), "s").limit(FREQUENT).toArrow())
    s, times = np.asarray(top.column(0), np.int64).view(np.uint64), np.asarray(top.column(1), np.int64)
    order = np.argsort(s)
    return s[order], times[order]


def _shared_cells(texts: DataFrame, percent: int) -> DataFrame:
    """(p, c, n_p, n_c, main): pivot and member of every cell and their sizes; main marks the first pivot of a cell.

    Pairs whose sizes rule a link out are kept only as a region's members.
    """
    spark = texts.sparkSession
    marks = spark.sparkContext.broadcast(frequent_shingles(texts))

    def rare(batches):
        common, times = marks.value
        for _, _, s in _runs(batches, 0):
            chosen, is_common = s.rarest(s.distinct(), common, times, percent)
            n = s.sizes[s.owner[chosen]].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.hashes[chosen].view(np.int64)), pa.array(s.keys[s.owner[chosen]]), pa.array(np.where(is_common, -n, n))], names=["s", "c", "n"])

    def table(pairs):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], names=["p", "c", "n_p", "n_c", "main"])

    def cells(batches):
        """Rows come sorted by shingle and set; a cell may run over batches. Common shingles pass through, as p, with main = -1."""
        carry, buffer, pairs = np.zeros((3, 0), np.int64), [], np.zeros((5, 0), np.int64)
        for batch in batches:
            rows = np.stack([np.asarray(x, np.int64) for x in batch.columns])
            crowd = rows[2] < 0
            if crowd.any():
                s, c, n = rows[:, crowd]
                yield table([s, c, np.zeros(len(s), np.int64), -n, np.full(len(s), -1)])
                rows = rows[:, ~crowd]
            if rows.shape[1]:
                buffer.append(rows)
            if sum(x.shape[1] for x in buffer) >= 1 << 18:
                new, carry = meet(buffer, carry)
                buffer, pairs = [], distinct_columns(np.concatenate([pairs, new], 1))
                if pairs.shape[1] >= 1 << 19:
                    yield table(pairs)
                    pairs = np.zeros((5, 0), np.int64)
        if buffer:
            pairs = distinct_columns(np.concatenate([pairs, meet(buffer, carry)[0]], 1))
        yield table(pairs)

    def meet(buffer, carry):
        """carry: the cell that was open, as its first pivots."""
        s, c, n = np.concatenate([carry, *buffer], 1)
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (c[1:] != c[:-1])
        s, c, n = s[new], c[new], n[new]
        head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        cell = np.cumsum(np.concatenate([[True], s[1:] != s[:-1]])) - 1
        at = np.arange(len(s)) - head[cell]
        pairs = []
        for k in range(1 + MORE_PIVOTS):
            some = np.flatnonzero(at > k if k == 0 else (at > k) & (s % MORE_EVERY == 0))
            pivot = head[cell[some]] + k
            if k:
                fits = np.maximum(n[pivot], n[some]) * percent <= np.minimum(n[pivot], n[some]) * 100
                pivot, some = pivot[fits], some[fits]
            pairs.append(np.stack([c[pivot], c[some], n[pivot], n[some], np.full(len(some), int(k == 0))]))
        last = slice(head[-1], head[-1] + 1 + MORE_PIVOTS)
        return np.concatenate(pairs, 1), np.stack([s[last], c[last], n[last]])

    kind = "p bigint, c bigint, n_p bigint, n_c bigint, main bigint"
    # cells of common shingles may hold a large share of all sets: their rows are dealt out by set as well, and their
    # pivots are found by partial minima. Common ones are marked by a size below zero.
    place = F.when(F.col("n") < 0, F.xxhash64("s", "c")).otherwise(F.col("s"))
    met = stored(texts.mapInArrow(rare, "s bigint, c bigint, n int").repartition(place).sortWithinPartitions("s", "c").mapInArrow(cells, kind), "met")
    usual = met.filter("main >= 0")
    crowd = met.filter("main < 0").select(F.col("p").alias("s"), "c", F.col("n_c").alias("n"))
    heads = crowd.groupBy("s").agg(F.min(F.struct(F.col("c").alias("p"), F.col("n").alias("n_p"))).alias("head"))  # FREQUENT rows at most
    crowded = (crowd.join(F.broadcast(heads.select("s", "head.*")), "s").filter("c <> p")
               .select("p", "c", "n_p", F.col("n").alias("n_c"), F.lit(1).cast("bigint").alias("main")))
    return usual.unionByName(crowded).groupBy("p", "c").agg(*[F.max(k).alias(k) for k in ("n_p", "n_c", "main")])


def signatures(s: Sets, some: np.ndarray, fine: bool = False) -> list[bytes | None]:
    """Shingles in each class of the leading bits of their hashes, up to 255, for some of the sets; fine: None for small sets."""
    power = np.ceil(np.log2(np.maximum(s.sizes[some], 1) / (BINS * PER_BIN))).astype(np.int64)
    power = np.clip(power, 0, (MOST_BINS // BINS).bit_length() - 1) * int(fine)
    out = np.full(len(some), None)
    for k in np.unique(power[power > 0] if fine else power):
        own, width = np.flatnonzero(power == k), BINS << int(k)
        place = np.full(len(s.sizes), -1)
        place[some[own]] = np.arange(len(own))
        at = place[s.owner]
        classes = (s.hashes[at >= 0] >> _U(65 - width.bit_length())).astype(np.int64)
        counts = np.bincount(at[at >= 0] * width + classes, minlength=len(own) * width)
        out[own] = [row.tobytes() for row in np.minimum(counts, 255).astype(np.uint8).reshape(-1, width)]
    return out.tolist()


class Marks:
    """Signatures of a run of sets, those with equally many classes in one array."""

    def __init__(self, column: pa.Array):
        marks = column.to_pylist()
        self.width = np.array([len(x) for x in marks], np.int64)
        self.place, self.rows = np.zeros(len(marks), np.int64), {}
        for width in np.unique(self.width):
            own = np.flatnonzero(self.width == width)
            self.place[own] = np.arange(len(own))
            self.rows[int(width)] = np.frombuffer(b"".join([marks[k] for k in own]), np.uint8).reshape(-1, width)

    def take(self, at: np.ndarray, width: int, classes: int) -> np.ndarray:
        """Signatures of sets of one width as of fewer classes."""
        rows = self.rows[width][self.place[at]]
        return rows.astype(np.int16) if classes == width else np.minimum(rows.reshape(len(rows), classes, -1).sum(2, dtype=np.int16), 255)

    def apart(self, own: np.ndarray | int, others: Marks, at: np.ndarray) -> np.ndarray:
        """For each pair of a set of own (an index each, or one) and a set of others: no more than the shingles that only one has."""
        out, one = np.zeros(len(at), np.int64), np.ndim(own) == 0
        widths = (self.width[own] << 32) + others.width[at]
        for both in np.unique(widths):
            a, b = int(both >> 32), int(both & 0xFFFFFFFF)
            same = np.flatnonzero(widths == both)
            step = max(1, (1 << 19) // max(a, b))
            for part in (same[k:k + step] for k in range(0, len(same), step)):
                mine = self.take(np.array([own]) if one else own[part], a, min(a, b))
                out[part] = np.abs(mine - others.take(at[part], b, min(a, b))).sum(1, dtype=np.int64)
        return out


def _set_table(texts: DataFrame, needed: DataFrame) -> str:
    """The texts of needed sets, one each, as a table in buckets by set: joins with it move only the other side."""
    def packed(batches):
        for _, t, s in _runs(batches, 0):
            some = s.distinct()
            data = [zstandard.compress(x.encode(), 3) for x in t.take(pa.array(some)).to_pylist()]
            marks = [pa.array(signatures(s, some, fine), pa.binary()) for fine in (False, True)]
            yield pa.RecordBatch.from_arrays([pa.array(s.keys[some]), *marks, pa.array(data, pa.binary())], names=["c", "mark", "fine", "text"])

    spark = texts.sparkSession
    table, buckets = f"sets_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    (texts.mapInArrow(packed, "c bigint, mark binary, fine binary, text binary").repartition(buckets, "c").join(needed, "c", "left_semi")
     .groupBy("c").agg(F.first(F.struct("mark", "fine", "text")).alias("own")).select("c", "own.*")
     .write.bucketBy(buckets, "c").option("path", scratch_path(spark, table)).saveAsTable(table))
    return table


def _open_pairs(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b) of pairs (a, b, n_a, n_b, mark_a, mark_b) whose signatures allow a link."""
    def keep(batches):
        for batch in batches:
            if not len(batch):
                continue
            n = np.asarray(batch.column(2), np.int64) + np.asarray(batch.column(3), np.int64)
            every = np.arange(len(batch))
            apart = Marks(batch.column(4)).apart(every, Marks(batch.column(5)), every)
            yield batch.filter(pa.array(apart * (100 + percent) <= n * (100 - percent))).select(["a", "b"])

    return pairs.select("a", "b", "n_a", "n_b", "mark_a", "mark_b").mapInArrow(keep, "a bigint, b bigint").distinct()


def _open_in_regions(region: DataFrame, percent: int, complete: bool = False) -> DataFrame:
    """Distinct (a, b, n_a, n_b) of different components in one region that sizes, distances to the pivot and signatures leave open.

    Members outside the pivot's component meet all members in pairs of blocks of bounded size; only open pairs become
    rows. With complete, pairs of one component are taken as well, and all members meet all.
    """
    sizes = region.groupBy("p").agg(F.count(F.lit(1)).alias("m"), F.sum((F.col("root") != F.col("home")).cast("long")).alias("out"))
    member = F.struct("c", "n", "d", "root", "mark")
    known = region.join(sizes.filter("m > 1" if complete else "out > 0 and m > 1"), "p")
    side = (lambda rows, size, block: rows.withColumn("block", F.pmod(F.xxhash64("c"), F.ceil(F.col(size) / block)))
            .groupBy("p", "block").agg(F.collect_list(member).alias("x")))
    apart = side(known, "m", 1 << 10) if complete else side(known.filter("root <> home"), "out", 1 << 10)
    every = side(known, "m", 1 << 12)

    def columns(cell):
        flat = cell.values
        c, n, root = (np.asarray(flat.field(k), np.int64) for k in ("c", "n", "root"))
        d = np.asarray(flat.field("d").to_numpy(zero_copy_only=False), np.float64)  # unknown: NaN
        return c, n, d, root, Marks(flat.field("mark"))

    def keep(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                (c, n, d, root, mark), (oc, on, od, oroot, omark) = columns(batch.column(0)[k]), columns(batch.column(1)[k])
                pairs = []
                for i in range(len(c)):
                    fits = ((oc > c[i] if complete else oroot != root[i]) & (np.maximum(on, n[i]) * percent <= np.minimum(on, n[i]) * 100)
                            & ~(np.abs(od - d[i]) > 1 - percent / 100 + 1e-9))
                    at = np.flatnonzero(fits)
                    at = at[mark.apart(i, omark, at) * (100 + percent) <= (on[at] + n[i]) * (100 - percent)]
                    one, two = np.stack([np.full(len(at), c[i]), np.full(len(at), n[i])]), np.stack([oc[at], on[at]])
                    pairs.append(np.where(oc[at] > c[i], np.concatenate([one, two]), np.concatenate([two, one])))
                pairs = distinct_columns(np.concatenate(pairs, 1))
                yield pa.RecordBatch.from_arrays([pa.array(pairs[k]) for k in (0, 2, 1, 3)], names=["a", "b", "n_a", "n_b"])

    return (apart.select("p", "x").join(every.select("p", F.col("x").alias("y")), "p").select("x", "y")
            .mapInArrow(keep, "a bigint, b bigint, n_a bigint, n_b bigint").distinct())


def _distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with the sizes of both sets and of what they share."""
    keep = pairs.columns
    left, right = sets.select(F.col("c").alias("a"), F.col("text").alias("text_a")), sets.select(F.col("c").alias("b"), F.col("text").alias("text_b"))

    def compare(batches):
        kept("shingles")
        last, mine = None, None
        for batch in batches:
            a_keys, one, two = batch.column(keep.index("a")).to_pylist(), batch.column(len(keep)), batch.column(len(keep) + 1)
            start = 0
            while start < len(a_keys):
                texts, size = [], 0
                while start + len(texts) < len(a_keys) and size < RUN_BYTES // 2:
                    texts.append(zstandard.decompress(two[start + len(texts)].as_py()))
                    size += len(texts[-1])
                other = Sets(pa.array(texts, pa.binary()))
                sizes, shared = [], []
                for k, a in enumerate(a_keys[start:start + len(texts)]):
                    if a != last or mine is None:
                        last, mine = a, Sets(pa.array([zstandard.decompress(one[start + k].as_py())], pa.binary())).hashes
                    theirs = other.hashes[other.bounds[k]:other.bounds[k + 1]]
                    place = np.searchsorted(mine, theirs)
                    shared.append(int((mine[np.minimum(place, len(mine) - 1)] == theirs).sum()))
                    sizes.append(len(mine))
                rest = batch.slice(start, len(texts)).columns[:-2]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(sizes, pa.int64()), pa.array(other.sizes, pa.int64()), pa.array(shared, pa.int64())],
                                                 names=[*keep, "n_a", "n_b", "shared"])
                start += len(texts)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return (pairs.join(right, "b").join(left, "a").select(*keep, "text_a", "text_b")
            .mapInArrow(compare, f"{kinds}, n_a bigint, n_b bigint, shared bigint"))


def _linked(percent: int):
    return F.col("shared") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("shared")) * percent


def components(links: DataFrame) -> DataFrame:
    """(v, root) for every vertex of links (a, b); root is the same in one component only.

    Each round gives every vertex to its smallest neighbour and contracts; the edges that are left shrink until none is.
    """
    edges = stored(links.select("a", "b").filter("a <> b").distinct(), "edges")
    label = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("root")), "roots")
        if label is None:
            label = step
        else:
            up = step.select(F.col("v").alias("root"), F.col("root").alias("higher"))
            label = stored(label.join(up, "root", "left").select("v", F.coalesce("higher", "root").alias("root")), "roots")
        edges = stored(edges.join(step.toDF("a", "x"), "a").join(step.toDF("b", "y"), "b").filter("x <> y")
                       .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return label


def jaccard_components(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text",
                       complete: bool = False) -> tuple[DataFrame, DataFrame]:
    """(membership, links).

    membership: one row per input row: id, n_shingles, set_key, component_id (the smallest id reachable by links, its
    own included). links: (a, b, n_a, n_b, shared) of set keys, links that were found; equal texts have one key, and
    pairs whose sets were already joined by other links are not compared, so the components are complete and the list of
    links is not every pair of a group. With complete, links holds every pair of different sets that link, once and with
    a < b; it grows with the links there are.

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased; a set holds the distinct runs of
    SHINGLE words, or the whole sequence where there are fewer. Two sets link when shared * 100 >= percent * union. NULL
    and empty texts have no set and no link. NULL ids are kept as rows but name no component; ids may repeat. Other
    columns are left out; an empty table gives empty results. Words, shingles and sets are told apart by 64-bit hashes.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    ready(docs.sparkSession)
    rows = pick(docs, id=id_col, text=text_col)
    texts = rows.select("text").filter("text is not null and text <> ''")

    def keyed(batches):
        for part, _, s in _runs(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s.sizes, pa.int64()), pa.array(s.keys)], names=["id", "n_shingles", "set_key"])

    cells = stored(_shared_cells(texts, percent), "cells")
    needed = cells.select("p").union(cells.select("c")).distinct().withColumnRenamed("p", "c")
    sets = docs.sparkSession.table(_set_table(texts, needed))
    marks, finest = sets.select("c", "mark"), sets.select("c", F.coalesce("fine", "mark"))
    fits = (lambda m, n: F.greatest(m, n) * percent <= F.least(m, n) * 100)

    def compared(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, n_a, n_b) that may link, with what they share."""
        marked = pairs.join(finest.toDF("a", "mark_a"), "a").join(finest.toDF("b", "mark_b"), "b")
        return _distances(_open_pairs(marked, percent), sets)

    near = stored(compared(cells.filter(fits(F.col("n_p"), F.col("n_c"))).select(
        F.col("p").alias("a"), F.col("c").alias("b"), F.col("n_p").alias("n_a"), F.col("n_c").alias("n_b"))), "pivots")
    found = ("a", "b", "n_a", "n_b", "shared")
    links = near.filter(_linked(percent)).select(*found)

    # members of a region with their distance to its pivot, where it isn't known to be beyond the radius
    distance = 1 - F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))
    members = stored(cells.filter("main = 1").select("p", "c", F.col("n_c").alias("n"))
                     .join(near.select(F.col("a").alias("p"), F.col("b").alias("c"), distance.alias("d")), ["p", "c"], "left")
                     .join(marks, "c"), "members")
    rounds, before = 0, None
    while True:
        # without labels every set is a component of its own: all pairs of a region are open
        label = components(links.limit(0) if complete else links)
        region = stored(members.join(label.toDF("c", "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
                        .join(label.toDF("p", "home"), "p", "left").withColumn("home", F.coalesce("home", "p")), "regions")
        crowds = (region.groupBy("p").agg(F.count(F.lit(1)).alias("m"), F.sum((F.col("root") != F.col("home")).cast("long")).alias("out"))
                  .filter(F.col("m") * F.col("out") > CROWD))
        open_ = crowds.agg(F.coalesce(F.sum(F.col("m") * F.col("out")), F.lit(0))).first()[0]
        if complete or not open_ or (before is not None and open_ > 0.8 * before):
            break
        # the members nearest to the pivot are nearer to the middle of the group: further pivots for those outside
        nth = F.row_number().over(Window.partitionBy("p").orderBy("d", "c"))
        chosen = (region.filter("d is not null").join(crowds.select("p"), "p", "left_semi").select("p", "c", "n", "d")
                  .withColumn("nth", nth).filter(F.col("nth") <= (rounds + 1) * ROUND_PIVOTS).filter(F.col("nth") > rounds * ROUND_PIVOTS)
                  .select("p", F.col("c").alias("a"), F.col("n").alias("n_a")))
        outside = region.filter("root <> home").select("p", F.col("c").alias("b"), F.col("n").alias("n_b"))
        pairs = (outside.join(chosen, "p").filter((F.col("a") != F.col("b")) & fits(F.col("n_a"), F.col("n_b")))
                 .select("a", "b", "n_a", "n_b").distinct())
        more = stored(compared(pairs), "more-pivots").filter(_linked(percent)).select(*found)
        if more.isEmpty():
            break
        links, rounds, before = links.unionByName(more), rounds + 1, open_

    last = stored(compared(_open_in_regions(region, percent, complete)).filter(_linked(percent)).select(*found), "last-links")
    links = links.unionByName(last)
    if complete:  # a pair may have met as pivot and member, in either order, and in a region
        turned = F.col("a") > F.col("b")
        links = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(turned, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"),
                                    F.when(turned, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"), "shared").distinct(), "all-links")
    label = components(links)

    keys = stored(rows.mapInArrow(keyed, f"id {rows.schema['id'].dataType.simpleString()}, n_shingles bigint, set_key bigint"), "set-keys")
    least = (keys.filter("n_shingles > 0").groupBy("set_key").agg(F.min("id").alias("least"))
             .join(label.toDF("set_key", "root"), "set_key", "left").withColumn("root", F.coalesce("root", "set_key")))
    least = stored(least, "least-ids")
    top = stored(least.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
    by_key = stored(least.join(top, "root").select("set_key", F.col("component_id")), "components")
    membership = (keys.join(by_key, "set_key", "left")
                  .select("id", "n_shingles", "set_key", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")))
    return membership, links


def link_counts(membership: DataFrame, links: DataFrame) -> DataFrame:
    """membership with n_links: how many other rows each row links to. links: as from complete.

    Equal sets stay one key: a row links to the others of its key, and to all rows of the keys its key links to.
    """
    rows = stored(membership.filter("n_shingles > 0").groupBy("set_key").agg(F.count(F.lit(1)).alias("n_rows")), "rows-of-keys")
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    far = (both.join(rows.select(F.col("set_key").alias("b"), "n_rows"), "b")
           .groupBy(F.col("a").alias("set_key")).agg(F.sum("n_rows").alias("n_far")))
    counts = stored(rows.join(far, "set_key", "left")
                    .select("set_key", (F.col("n_rows") - 1 + F.coalesce("n_far", F.lit(0))).alias("n_links")), "link-counts")
    full = F.when(F.col("n_shingles") > 0, F.col("n_links")).otherwise(F.lit(0)).cast("bigint")
    return membership.join(counts, "set_key", "left").select(*membership.columns, full.alias("n_links"))
