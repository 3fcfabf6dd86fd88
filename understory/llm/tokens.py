"""Token ids of whole texts by a public tokenizer file, with a per-worker store of encoded pieces.

Ids are always the library's. Its byte-pair merges never cross the borders that its own splitting
step draws, so a text is cut at (some of) these borders, each distinct piece is encoded once by the
library, and a text's ids are those of its pieces in order. Texts for which the cut and the library
could disagree (special strings, rare white space) go to the library whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from understory.llm.text import kept, text_runs

#: A store of more pieces than this is started afresh; it bounds a worker's memory only.
MAX_PIECES = 250_000
#: Longer pieces are encoded anew each time.
MAX_STORED_CHARS = 48

#: White space and signs on which the library and the cuts could differ, as a character class.
_ODD = r"\x00-\x08\x0b\x0c\x0e-\x1f\x85" + "".join(f"{a}-{b}" for a, b in (
    "\u00a0\u00a0", "\u1680\u1680", "\u180e\u180e", "\u2000\u200f", "\u2028\u202f", "\u205f\u2064", "\u3000\u3000", "\ufeff\ufeff"))
_ODD_RE = re.compile(f"[{_ODD}]")
_BYTE_CHUNKS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Outside the letters up to U+024F, or an English contraction: not for the Arrow cut.
_NOT_SIMPLE = f"[\u0130\u0250-\U0010ffff{_ODD}]|<\\||'(?i:s|t|re|ve|m|ll|d)"

#: Marks that stand for white space while Arrow splits at blanks, and the way back.
_MARKS = ((" ", " \x01"), ("\n", " \x02 "), ("\t", " \x03 "), ("\r", " \x04 "))
_BACK = {1: " ", 2: "\n", 3: "\t", 4: "\r"}


def encoder(path: str) -> Encoder:
    """The worker's encoder for one tokenizer file, until it takes up other work."""
    encoders = kept("tokens")
    if path not in encoders:
        encoders[path] = Encoder(path)
    return encoders[path]


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free code from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            text = f.read()
        spec = json.loads(text)
        self.tokenizer = Tokenizer.from_str(text)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        kind, norm = spec["pre_tokenizer"] or {}, spec["normalizer"]
        #: "bytes": white space is kept and leads its word; "words": lower-cased, white space dropped
        self.kind = ("bytes" if kind.get("type") == "ByteLevel" and kind["use_regex"] and not norm else
                     "words" if spec["model"].get("end_of_word_suffix") and norm
                     and norm["normalizers"][-1]["type"] == "Lowercase" else "")
        self.letters = _byte_letters()
        self.marks = {m: self.letters[ord(c)] for m, c in _BACK.items()}
        self.not_simple = _NOT_SIMPLE + (r"|\s{3}|\s{2}$" if self.kind == "bytes" else "")
        self.chunks, self.words = _Store(self._library), _Store(self._model)

    def _library(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        enc = self.tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        return np.array(enc.ids, np.uint32), np.bincount(np.array(enc.word_ids, np.int64), minlength=len(pieces))

    def _model(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that are normalised and split already."""
        ids, letters, tokenize, marks = [], self.letters, self.tokenizer.model.tokenize, self.marks
        marked = self.kind == "bytes"  # only there do pieces hold marks
        for p in pieces:
            if not p.isascii():
                p = "".join([letters[b] for b in (p.translate(_BACK) if marked else p).encode()])
            elif marked:
                p = p.translate(marks)
            ids.append([t.id for t in tokenize(p)])
        return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each text has. No NULLs."""
        n = len(texts)
        if self.kind:
            simple = ~np.asarray(pc.match_substring_regex(texts, self.not_simple).to_numpy(zero_copy_only=False), bool)
        else:
            simple = np.zeros(n, bool)
        if simple.all() and n:
            return self._arrow(texts)
        slow = [self._one(t.as_py()) for t in texts.filter(pa.array(~simple))]
        fast, sizes = self._arrow(texts.filter(pa.array(simple))) if simple.any() else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        counts = np.zeros(n, np.int64)
        counts[simple] = sizes
        counts[~simple] = [len(x) for x in slow]
        flat = np.zeros(counts.sum(), np.uint32)
        owner = np.repeat(simple, counts)
        flat[owner] = fast
        flat[~owner] = np.concatenate(slow) if slow else fast[:0]
        return flat, counts

    def _one(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if not self.kind or any(s in text for s in self.specials) or _ODD_RE.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        pieces = _BYTE_CHUNKS.findall(text) if self.kind == "bytes" else text.split()
        return self.chunks.ids(pieces)[0]

    def _arrow(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Letters up to U+024F: runs of letters, digits and other signs become white-space separated pieces."""
        if self.kind == "words":
            spaced = pc.replace_substring_regex(pc.utf8_lower(texts), r"([^\s\p{L}\p{N}]+|\p{N})", r" \1 ")
        else:  # a blank leads the piece after it; each other white space is a piece
            for sign, mark in _MARKS:
                texts = pc.replace_substring(texts, sign, mark)
            spaced = pc.replace_substring_regex(texts, r"(\x01?[^\s\p{L}\p{N}\x01-\x04]+|\x01?\p{N}+)", r" \1 ")
        pieces = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(spaced))
        if isinstance(pieces, pa.ChunkedArray):
            pieces = pieces.combine_chunks()
        coded = pc.dictionary_encode(pieces.flatten())
        flat, sizes = self.words.ids(coded.dictionary.to_pylist(), np.asarray(coded.indices, np.int64))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        stops = np.cumsum(np.asarray(pc.list_value_length(pieces), np.int64))
        return flat, np.diff(ends[np.concatenate([[0], stops])])


class _Store:
    """Ids of pieces met before, in one array."""

    def __init__(self, encode):
        self._encode = encode
        self._fresh()

    def _fresh(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.bounds, self.count = np.zeros(1 << 14, np.int64), 0

    def _add(self, pieces: list[str]) -> list[int]:
        ids, sizes = self._encode(pieces)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + len(pieces) + 1 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        self.flat[self.used:self.used + len(ids)] = ids
        self.bounds[self.count + 1:self.count + 1 + len(pieces)] = self.used + np.cumsum(sizes)
        codes = range(self.count, self.count + len(pieces))
        self.used += len(ids)
        self.count += len(pieces)
        self.index.update((p, k) for p, k in zip(pieces, codes) if len(p) <= MAX_STORED_CHARS)
        return list(codes)

    def ids(self, pieces: list[str], order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces laid one after another, and the size of each; order picks pieces by position."""
        if self.count > MAX_PIECES:
            self._fresh()
        codes = list(map(self.index.get, pieces))
        new = list(dict.fromkeys(p for p, k in zip(pieces, codes) if k is None))
        if new:
            known = dict(zip(new, self._add(new)))
            codes = [known[p] if k is None else k for p, k in zip(pieces, codes)]
        at = np.array(codes, np.int64)
        if order is not None:
            at = at[order]
        begin = self.bounds[at]
        sizes = self.bounds[at + 1] - begin
        shift = np.repeat(begin - np.cumsum(sizes) + sizes, sizes)
        return self.flat[shift + np.arange(len(shift))], sizes


def encoded_runs(column: pa.Array, path: str, max_bytes: int):
    """(start, end, ids, counts) for runs of rows of bounded size."""
    enc = encoder(path)
    for start, end, texts in text_runs(column, max_bytes):
        yield (start, end, *enc.encode(texts))
