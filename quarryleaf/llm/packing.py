"""Packing of token sequences by the online sum-of-squares rule."""

from __future__ import annotations

import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quarryleaf.llm import textbuf
from quarryleaf.llm.common import batches, texts

#: Words of a tokenizer's cache, at most; then it starts anew.
CACHE_WORDS = 1 << 19
#: Slots in front of the sorted words: most lookups end there.
SLOT_BITS = 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordTokenizer:
    """Ids of a `tokenizers` file whose words are split by a pattern before merging, through a cache of words.

    Plain texts (Latin letters, in NFC, without the added tokens' strings) are split here and each new word is encoded
    once; every other text is encoded whole. Both ways give the library's ids. The cache is a sorted array of 64-bit
    word hashes.
    """

    # fixed values: the split pattern of the tokenizer file
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    ODD = r"[^\x09-\x0d\x20-\x7e\xa1-\xac\xae-įı-žƀ-ǃǍ-ǰ]"

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        split = [x for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if x.get("type") == "Split"]
        self.cached = [x["pattern"] for x in split] == [{"Regex": self.PATTERN}] and [x["type"] for x in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        self.split, self.odd = regex.compile(self.PATTERN).findall, regex.compile(self.ODD).search
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self._forget()

    def _forget(self) -> None:
        self.known, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.slot_hash, self.slot_word = np.zeros(1 << SLOT_BITS, np.uint64), np.full(1 << SLOT_BITS, -1, np.int32)

    def plain(self, text: str) -> bool:
        return self.cached and not self.odd(text) and (text.isascii() or unicodedata.is_normalized("NFC", text)) and not any(x in text for x in self.added)

    def ids(self, text: str) -> np.ndarray:
        if not self.plain(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return self._of([w.encode() for w in self.split(text.lower())])

    def _of(self, words: list[bytes]) -> np.ndarray:
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        ends = np.cumsum(np.array([len(w) for w in words], dtype=np.int64))
        return self._looked_up(data, ends - np.diff(ends, prepend=0), ends)[0]

    def _looked_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        h = textbuf.hash_spans(data, starts, ends)
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        at = self.slot_word[slot].astype(np.int64)
        missed = np.flatnonzero(self.slot_hash[slot] != h)
        if len(missed):
            at[missed] = self._sought(h[missed])
            new = missed[at[missed] < 0]
            if len(new):
                if len(self.known) > CACHE_WORDS:
                    self._forget()
                    return self._looked_up(data, starts, ends)
                self._learn(h, new, data, starts, ends)
                at[new] = self._sought(h[new])
        n = self.count[at]
        return self.flat[np.repeat(self.begin[at] - np.cumsum(n) + n, n) + np.arange(n.sum())], n

    def _sought(self, h: np.ndarray) -> np.ndarray:
        """Numbers of words by their hashes, -1 for unknown ones."""
        if not len(self.known):
            return np.full(len(h), -1)
        k = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.where(self.known[k] == h, self.number[k], -1)

    def _learn(self, h: np.ndarray, new: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        fresh, first = np.unique(h[new], return_index=True)
        made = self.whole.encode_batch_fast([data[starts[i] : ends[i]].tobytes().decode() for i in new[first]], add_special_tokens=False)
        ids = [e.ids for e in made]
        count = np.array([len(x) for x in ids], dtype=np.int64)
        number = len(self.count) + np.arange(len(fresh))
        self.begin = np.concatenate((self.begin, len(self.flat) + np.cumsum(count) - count))
        self.count = np.concatenate((self.count, count))
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(ids), dtype=np.uint32)))
        known, numbers = np.concatenate((self.known, fresh)), np.concatenate((self.number, number))
        order = np.argsort(known, kind="stable")
        self.known, self.number = known[order], numbers[order]
        slot = (fresh >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        free = self.slot_word[slot] < 0
        self.slot_hash[slot[free]], self.slot_word[slot[free]] = fresh[free], number[free]

    def rows(self, text: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each row. Rows of ASCII and Latin-1 letters are split and looked up together, on their bytes."""
        data, off = textbuf.raw_bytes(text)
        kind, before = _KIND[data], np.concatenate((np.zeros(1, np.uint8), data[:-1]))
        after = before == 0xC3
        cont = (data >= 0x80) & (data < 0xC0)
        bad = (kind == 9) | (cont & ~(after & (data != 0x97) & (data != 0xB7))) | ((data == 0x7C) & (before == 0x3C))
        upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(bad)))
        slow = (upto[off[1:]] > upto[off[:-1]]) | (not self.cached)
        low = textbuf.LOWER[data]
        low = low + np.where(after & (data >= 0x80) & (data <= 0x9E), np.uint8(0x20), np.uint8(0))
        previous = np.concatenate((np.zeros(1, np.uint8), kind[:-1]))
        first, last = (kind != previous) | (kind == 2), np.ones(len(kind), dtype=bool)
        inner = off[(off > 0) & (off < len(data))]
        first[inner] = True
        last[:-1] = first[1:]
        live = np.repeat(~slow, np.diff(off)) & (kind != 0)
        starts, ends = np.flatnonzero(first & live), np.flatnonzero(last & live) + 1
        flat, n = self._looked_up(low, starts, ends)
        total = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
        bound = total[np.searchsorted(starts, off)]
        for r in range(len(text)):
            yield self.ids(text[r].as_py()) if slow[r] else flat[bound[r] : bound[r + 1]]


#: 0 white space, 1 letter, 2 digit, 3 other; 9: a row with this byte is split by the pattern itself.
_KIND = np.full(256, 3, dtype=np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[65:91] = _KIND[97:123] = _KIND[0x80:0xC0] = _KIND[0xC3] = 1
_KIND[48:58] = 2
_KIND[[*range(9), *range(14, 32), 127, 39, *range(0xC0, 0xC3), *range(0xC4, 256)]] = 9
_loaded: dict[str, WordTokenizer] = {}


def tokenizer_of(path: str) -> WordTokenizer:
    """One tokenizer and cache for all tasks of a worker process."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


class Piece:
    __slots__ = ("doc", "ids", "start", "total")

    def __init__(self, doc: int | None, start: int, ids: np.ndarray, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[:n], self.total), Piece(self.doc, self.start + n, self.ids[n:], self.total)


class SumOfSquares:
    """Online packer: counts[h] windows are filled to level h. A piece goes to the level, or to a new window, that
    leaves the smallest sum of squared counts; ties go to the fullest window."""

    def __init__(self, size: int):
        self.size = size
        self.counts = np.zeros(size + 1, dtype=np.int64)
        self.open: dict[int, list[list[Piece]]] = {}

    def place(self, piece: Piece) -> list[Piece] | None:
        """The pieces of the window that this one fills up, if it does."""
        n, size = len(piece.ids), self.size
        grown = self.counts[n:].copy()
        grown[-1] = -1  # a full window leaves the array: 2 * -1 + 2 = 0 against 2 * count + 1 for a partial one
        cost = grown * 2 + 1
        cost[-1] = 0
        cost[1:] += 1 - 2 * self.counts[1 : size - n + 1]
        cost[1:][self.counts[1 : size - n + 1] == 0] = np.iinfo(np.int64).max
        level = len(cost) - 1 - int(np.argmin(cost[::-1]))
        if level:
            window = self.open[level].pop()
            self.counts[level] -= 1
        else:
            window = []
        window.append(piece)
        if level + n == size:
            return window
        self.counts[level + n] += 1
        self.open.setdefault(level + n, []).append(window)
        return None

    def rest(self) -> Iterator[list[Piece]]:
        """Closes the partial windows: the fullest are topped up with cut pieces of the emptiest; the one that remains
        is cut into windows of powers of two, which need no padding."""
        left = deque(w for level in sorted(self.open, reverse=True) for w in self.open[level])
        self.open.clear()
        self.counts[:] = 0
        while left:
            window = left.popleft()
            gap = self.size - sum(len(p.ids) for p in window)
            while gap and left:
                piece = left[-1].pop()
                if len(piece.ids) > gap:
                    piece, tail = piece.cut(gap)
                    left[-1].append(tail)
                window.append(piece)
                gap -= len(piece.ids)
                if not left[-1]:
                    left.pop()
            if not gap:
                yield window
                continue
            todo = deque(window)
            fill = self.size - gap
            while fill:
                room = 1 << (fill.bit_length() - 1)
                fill -= room
                part: list[Piece] = []
                while room:
                    piece = todo.popleft()
                    if len(piece.ids) > room:
                        piece, tail = piece.cut(room)
                        todo.appendleft(tail)
                    part.append(piece)
                    room -= len(piece.ids)
                yield part


def pack(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its text and end_id (an empty or null text: end_id alone). Whole windows of `size` ids are
    cut off a longer one; the remainder goes through the packer of its partition. Sequences are as long as `size`, or a
    power of two shorter than it: there is no padding. Each partition packs by itself, without a shuffle: its state
    holds the ids of its partial windows, and a lost task is repeated with the same result. sequence_id has the
    partition in its high bits. Every row of the input counts, repeated rows and rows with a null id too.
    """

    def run(it):
        tokenizer, packer = tokenizer_of(tokenizer_path), SumOfSquares(size)
        sequence = (TaskContext.get().partitionId() << 40) - 1
        rows: list[tuple] = []

        def close(window: list[Piece]) -> None:
            nonlocal sequence
            sequence += 1
            offset = 0
            for p in window:
                rows.append((p.doc, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.total, sequence, offset))
                offset += len(p.ids)

        def batch() -> pa.RecordBatch:
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
            rows.clear()
            return out

        for b in batches(it):
            for doc, ids in zip(b.column("doc_id").to_pylist(), tokenizer.rows(b.column("text")), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                full = len(ids) // size * size
                for at in range(0, full, size):
                    close([Piece(doc, at, ids[at : at + size], len(ids))])
                if full < len(ids) and (done := packer.place(Piece(doc, full, ids[full:].copy(), len(ids)))):
                    close(done)
            if rows:
                yield batch()
        for window in packer.rest():
            close(window)
        if rows:
            yield batch()

    return texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)
