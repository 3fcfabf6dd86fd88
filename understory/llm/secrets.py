"""Secret scans: fixed patterns, and values in a credential context that would cost many guesses."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from understory.llm.text import pick, ready, text_runs
from understory.session import stored

# ---- fixed values: the base patterns, in the order of their kinds
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")   # AKIA[A-Z0-9]+ of 20 characters or more
HEX = re.compile(r"[0-9a-f]{24,}")          # [0-9a-f]+ of 24 characters or more
KINDS = ("assign", "access", "hex", "guess")
BASE_KINDS = KINDS[:3]
MIN_ASSIGNED = 6

#: Names that announce a credential, a separator, and the value up to white space or its closing quote.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth(?:orization)?)"""
    r"""["']?\x20*(?:=>|:=|[:=])\x20*(?:bearer\x20+|basic\x20+)?(?:"([^"\s]{6,})"|'([^'\s]{6,})'|([^\s"'<>,;]{6,}))""", re.I | re.A)
#: Words that passwords are often made of; a caller may give a longer list.
COMMON_WORDS = ("password", "passwd", "admin", "administrator", "root", "user", "guest", "login", "welcome", "letmein",
                "changeme", "change", "secret", "default", "master", "test", "testing", "example", "sample", "demo", "dummy",
                "placeholder", "null", "none", "undefined", "qwerty", "dragon", "monkey", "football", "baseball", "sunshine",
                "princess", "summer", "winter", "spring", "autumn", "monday", "friday", "january", "december", "hello",
                "love", "money", "shadow", "superman", "batman", "your", "enter", "here", "value", "token", "key", "true", "false")
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
_DATE = re.compile(r"(?:19|20)\d\d([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d")
_YEAR = re.compile(r"(?:19|20)\d\d")
_LOG_DATE, _LOG_YEAR = math.log10(365 * 100), math.log10(100)
_MAX_UNIT = 8
#: Distinct words of the documents, the most frequent first, that a guesser knows besides the common ones.
LEARNT_WORDS = 50_000
_WORD = re.compile(r"(?<![^\W_])[a-z]{4,20}(?![^\W_])")
_FLUSH = 100_000
_PLACES = 64


def _neighbours() -> set[tuple[str, str]]:
    """Pairs of signs next to each other on a keyboard row, in the alphabet, or in the digits, both ways."""
    lines = (*KEY_ROWS, ALPHABET, "0123456789")
    pairs = {(a, b) for line in lines for a, b in zip(line, line[1:])}
    return pairs | {(b, a) for a, b in pairs}


class _Starts:
    """Starts of pieces within one run, of which the cheapest for an end is known without trying them all.

    A piece costs by the logarithm of its length: of two starts the later one can only be ahead at first, and the earlier
    one stays ahead once it is. The stack holds starts that are ahead at some end to come, the first of them on top.
    """

    def __init__(self, end: int, price):
        self.end, self.price, self.stack = end, price, []

    def _at(self, start: tuple[int, float], j: int) -> float:
        return start[1] + self.price(j - start[0])

    @staticmethod
    def _ahead_from(early: tuple[int, float], late: tuple[int, float]) -> float:
        """End from which the earlier (and cheaper) start is ahead of the later one."""
        lead = late[1] - early[1]
        return late[0] + (late[0] - early[0]) / (math.expm1(min(lead, 300.0) * math.log(10)) or math.ulp(0.0))

    def least(self, i: int, cost: float, j: int) -> float:
        """Add start i, reached at `cost`; the least cost of a piece that ends at j. Calls come by ascending i and j."""
        stack, new = self.stack, (i, cost)
        while stack and stack[-1][1] >= cost:
            stack.pop()
        while len(stack) > 1 and self._at(stack[-2], j) <= self._at(stack[-1], j):
            stack.pop()
        if not stack or self._at(new, j) < self._at(stack[-1], j):
            while len(stack) > 1 and self._ahead_from(stack[-2], stack[-1]) <= self._ahead_from(stack[-1], new):
                stack.pop()
            stack.append(new)
        return self._at(stack[-1], j)


@dataclass(frozen=True)
class Guesser:
    """Cost of a value in log10 guesses: the cheapest way to cut it into words, dates, repeats, walks and brute force."""
    words: tuple[str, ...] = COMMON_WORDS
    rank: dict = field(default_factory=dict, compare=False)
    pairs: set = field(default_factory=_neighbours, compare=False)

    def __post_init__(self):
        self.rank.update({w: math.log10(k + 2) for k, w in enumerate(self.words)})

    def per_sign(self, value: str) -> float:
        size = (26 * any(c.islower() for c in value) + 26 * any(c.isupper() for c in value)
                + 10 * any(c.isdigit() for c in value) + 33 * any(not c.isalnum() for c in value))
        return math.log10(max(size, 10))

    def cost(self, value: str) -> float:
        """Dynamic programme over end positions: the minimum over all cuts, in time linear in the value's length."""
        n, brute, low = len(value), self.per_sign(value), value.lower()
        best = [math.inf] * (n + 1)
        best[0] = 0.0
        longest = max(map(len, self.words), default=0)
        dates = {}
        for m in (*_DATE.finditer(value), *_YEAR.finditer(value)):
            dates.setdefault(m.start(), []).append((m.end(), _LOG_DATE if m.end() - m.start() > 4 else _LOG_YEAR))
        # where a walk from i ends at the latest, and per unit how many signs from i are equal to those a unit later
        walk = list(range(1, n + 1))
        for i in range(n - 2, -1, -1):
            if (low[i], low[i + 1]) in self.pairs:
                walk[i] = walk[i + 1]
        repeats = []
        for unit in range(1, min(_MAX_UNIT, n // 2) + 1):
            same = [0] * n
            for i in range(n - unit - 1, -1, -1):
                same[i] = same[i + 1] + 1 if value[i] == value[i + unit] else 0
            if any(x >= unit for x in same):
                price = lambda signs, unit=unit: unit * brute + math.log10(signs // unit)
                repeats.append((unit, max(2 * unit, 3), same, price, {}))
        walked = _Starts(-1, None)
        for j in range(n + 1):
            if j >= 3 and (end := walk[j - 3]) >= j:
                if walked.end != end:
                    walked = _Starts(end, lambda signs: math.log10(94 * 4 * signs))
                best[j] = min(best[j], walked.least(j - 3, best[j - 3], j))
            for unit, shortest, same, price, runs in repeats:
                i = j - shortest
                if i >= 0 and same[i] >= shortest - unit:
                    end, place = i + same[i] + unit, j % unit
                    if place not in runs or runs[place].end != end:
                        runs[place] = _Starts(end, price)
                    best[j] = min(best[j], runs[place].least(i, best[i], j))
            if j == n:
                break
            here = best[j]
            best[j + 1] = min(best[j + 1], here + brute)
            for end in range(j + 3, min(n, j + longest) + 1):
                if (r := self.rank.get(low[j:end])) is not None:
                    capital = 0.0 if value[j:end] == low[j:end] else math.log10(2) if value[j + 1:end] == low[j + 1:end] else math.log10(end - j + 2)
                    best[end] = min(best[end], here + r + capital)
            for end, c in dates.get(j, ()):
                best[end] = min(best[end], here + c)
        return best[n]


def frequent_words(docs: DataFrame, text_col: str = "text", size: int = LEARNT_WORDS) -> tuple[str, ...]:
    """The most frequent words of 4 to 20 small letters in all texts (any case) that occur twice or more, ties by the word.

    At most `size`: words of about the same count (within one _PLACES-th of a doubling) are taken or left out together.
    Tasks count in memory and hand on what they have after every _FLUSH different words.
    """
    ready(docs.sparkSession)

    def count(batches):
        seen = Counter()

        def given():
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for _, _, texts in text_runs(batch.column(0)):
                for text in texts.to_pylist():
                    seen.update(_WORD.findall(text.lower()))
                    if len(seen) >= _FLUSH:
                        yield given()
        yield given()

    counted = stored(pick(docs, text=text_col).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
                     .filter("n > 1").withColumn("place", F.floor(F.log2("n") * _PLACES)), "word-counts")
    # how many words have about each count: some thousand rows at most
    words, least = 0, None
    for r in counted.groupBy("place").count().orderBy(F.col("place").desc()).collect():
        words += r["count"]
        if words > size:
            break
        least = r.place
    if least is None:
        return ()
    kept = counted.filter(F.col("place") >= least).collect()  # size at most
    return tuple(r.word for r in sorted(kept, key=lambda r: (-r.n, r.word)))


def _known(docs: DataFrame, text_col: str, words: tuple[str, ...] | None):
    """The words of a guesser, sent to tasks once: those given, or the common ones and the documents' own."""
    if words is None:
        words = tuple(dict.fromkeys((*COMMON_WORDS, *frequent_words(docs, text_col))))
    return docs.sparkSession.sparkContext.broadcast(words)  # LEARNT_WORDS short words at most, or the caller's list


def find_secrets(text: str, guesser: Guesser, min_log10_guesses: float) -> list[tuple[str, int, int, int, float | None]]:
    """(kind, start, end, start of the value, log10 guesses), by start, then kind; positions in code points."""
    found = []
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= MIN_ASSIGNED:
                found.append(("assign", m.start(), m.end(), m.start(2), None))
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m.start(), None) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), m.start(), None) for m in HEX.finditer(text)]
    if ":" in text or "=" in text:
        base = [(b, e) for _, b, e, _, _ in found]
        for m in CONTEXT.finditer(text):
            k = m.lastindex
            a, b = m.span(k)
            if not any(s <= a and b <= e for s, e in base):
                cost = guesser.cost(m[k])
                if cost >= min_log10_guesses:
                    found.append(("guess", a, b, a, cost))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


SPANS = "array<struct<kind:string,start:int,end:int,value_start:int,log10_guesses:double>>"


def _span_type() -> pa.DataType:
    return pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                               ("value_start", pa.int32()), ("log10_guesses", pa.float64())]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: tuple[str, ...] | None = None,
                 min_log10_guesses: float = 10.0) -> DataFrame:
    """One row per input row: id, text, spans (kind, start, end, value_start, log10_guesses).

    Kinds assign, access and hex are the base patterns, leftmost and not overlapping within a kind. Kind guess adds
    values after a credential name whose cheapest segmentation takes 10**min_log10_guesses guesses or more and that no
    base span holds. Without `words`, words cost by their rank in a fixed short list and then among the documents' own
    frequent ones. Whole texts of any length are scanned where they lie, without a shuffle; NULL text has no spans
    and stays NULL; ids may be NULL or repeated; other columns are left out.
    """
    ready(docs.sparkSession)
    known = _known(docs, text_col, words)
    id_type = next(f.dataType.simpleString() for f in docs.schema.fields if f.name == id_col)

    def scan(batches):
        guesser = Guesser(known.value)
        for batch in batches:
            for start, end, texts in text_runs(batch.column(1)):
                spans = [[dict(zip(("kind", "start", "end", "value_start", "log10_guesses"), s))
                          for s in find_secrets(t, guesser, min_log10_guesses)] for t in texts.to_pylist()]
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(spans, _span_type())],
                                                 names=["id", "text", "spans"])

    return pick(docs, id=id_col, text=text_col).mapInArrow(scan, f"id {id_type}, text string, spans {SPANS}")


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def redact(docs: DataFrame, mark: str = "[SECRET]", text_col: str = "text", words: tuple[str, ...] | None = None,
           min_log10_guesses: float = 10.0) -> DataFrame:
    """The table with each found value replaced by mark; names before a value stay. NULL texts stay NULL.

    All columns are kept; values that touch or overlap become one mark.
    """
    ready(docs.sparkSession)
    at = docs.columns.index(text_col)
    known = _known(docs, text_col, words)

    def clean(text: str | None, guesser: Guesser) -> str | None:
        if not text:
            return text
        out, done = [], 0
        for a, b in sorted((s[3], s[2]) for s in find_secrets(text, guesser, min_log10_guesses)):
            if a > done or not out:
                out += [text[done:a], mark]
            done = max(done, b)
        return "".join([*out, text[done:]]) if out else text

    def run(batches):
        guesser = Guesser(known.value)
        for batch in batches:
            for start, end, _ in text_runs(batch.column(at)):  # Python holds the texts of one run, not of a batch
                part = batch.slice(start, end - start)
                columns = part.columns
                columns[at] = pa.array([clean(t, guesser) for t in part.column(at).to_pylist()], batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
