"""Benchmark decontamination: CGK embedding of item-sized windows, bit-sampling LSH, exact edit verification.

A CGK walk reads a sequence from its start: at each step it writes the word under its pointer and moves on if a random bit
of step and word says so. Two sequences within few edits meet again after each edit, so that their writings agree in most
steps: edit distance becomes Hamming distance. Tables sample a few steps each; a window and an item that agree in all
steps of some table are compared by exact edit distance. Windows start at every word of every document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryleaf.llm import textbuf
from quarryleaf.llm.common import batches, kept_rows, texts

#: Word edits allowed, as a share of an item's words. Walks, hash tables of all walks, sampled steps of a table.
EDIT_RATE, WALKS, TABLES, SAMPLES = 0.2, 8, 16, 3
#: A walk's random bits repeat after so many steps; a pointer moves half a word a step, so seldom over the same words.
PERIOD = 16
#: Items whose lengths differ by less than this factor share their sampled steps, which lie within the shortest of them.
SPREAD = 1.5
#: Items of one pass: a bound on what is broadcast at once. More items are taken in blocks.
BLOCK_ITEMS = 20_000
_PAD = np.uint64(0x6C62272E07BB0142)
_SLICE = 1 << 15


def edits(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The least edit distance of the item to any stretch of the text, and the word after that stretch."""
    n = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, dtype=np.int64)
    for k, word in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = k
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (text != word))
        row = np.minimum.accumulate(new - n) + n
    end = int(np.argmin(row))
    return int(row[end]), end


class Walk:
    """One walk from every word of a sequence at once. `after[r]`: the pointers after r steps, r up to PERIOD; a whole
    period is a map from pointer to pointer, which is applied again for each further one."""

    def __init__(self, coins: np.ndarray):
        """coins: PERIOD bits of each word; those of the last, which stands for all beyond the end, are 0."""
        at = np.arange(len(coins))
        self.after = [at]
        for j in range(PERIOD):
            at = at + ((coins.take(at, mode="clip") >> np.uint16(j)) & np.uint16(1))
            self.after.append(at)
        self.periods = [self.after[0]]

    def step(self, j: int, starts: np.ndarray | None = None) -> np.ndarray:
        """The pointers of these starts, or all, at step j."""
        m, r = divmod(j, PERIOD)
        while len(self.periods) <= m:
            self.periods.append(self.after[PERIOD].take(self.periods[-1], mode="clip"))
        if starts is None:
            return self.after[r].take(self.periods[m], mode="clip") if m else self.after[r]
        return self.after[r].take(self.periods[m].take(starts, mode="clip") if m else starts, mode="clip")


def walks(h: np.ndarray) -> list[Walk]:
    """All walks over words, with an end that they don't leave. Four share a hash of each word, PERIOD bits each."""
    out = []
    for k in range(0, WALKS, 4):
        coins = textbuf.mix(h ^ textbuf.mix(np.array([k + 1], dtype=np.uint64)))
        coins = np.append(coins, np.uint64(0))
        out += [Walk((coins >> np.uint64(PERIOD * q)).astype(np.uint16)) for q in range(min(4, WALKS - k))]
    return out


def sampled_steps(size: int) -> np.ndarray:
    """(tables, samples) steps for items of `size` words or more, ascending, the same in every process: within the steps
    of which a pointer seldom leaves the item. The first is in the first period, where all sizes but small ones agree."""
    reach = max(1, int(1.6 * size))
    draw = textbuf.mix(np.arange(TABLES * SAMPLES, dtype=np.uint64)).reshape(TABLES, SAMPLES)
    out = (draw % np.uint64(reach)).astype(np.int64)
    out[:, 0] = (draw[:, 0] % np.uint64(min(reach, PERIOD))).astype(np.int64)
    return out


def size_classes(lengths: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(least length, items) of classes whose lengths differ by less than SPREAD."""
    out, order, a = [], np.argsort(lengths, kind="stable"), 0
    while a < len(order):
        low = int(lengths[order[a]])
        b = int(np.searchsorted(lengths[order], max(low + 1, math.ceil(low * SPREAD)), "left"))
        out.append((low, order[a:b]))
        a = b
    return out


@dataclass
class Items:
    """A block of benchmark items, ready for search. Words of items are numbered from 1; any other word is 0."""

    ids: list[int]
    words: list[np.ndarray]
    rate: float = EDIT_RATE

    def __post_init__(self):
        self.length = np.array([len(w) for w in self.words], dtype=np.int64)
        self.allowed = np.floor(self.length * self.rate).astype(np.int64)
        self.vocabulary = np.unique(np.concatenate([*self.words, np.zeros(0, np.uint64)]))
        # words by their low bits: 0 none, -1 several
        self.mask = np.uint64((1 << min(23, (32 * len(self.vocabulary) + 1).bit_length())) - 1)
        slot = (self.vocabulary & self.mask).astype(np.int64)
        self.slots = np.zeros(int(self.mask) + 1, dtype=np.int32)
        self.slots[slot] = np.arange(1, len(slot) + 1)
        self.slots[np.flatnonzero(np.bincount(slot, minlength=1) > 1)] = -1
        self.numbers = [np.searchsorted(self.vocabulary, w).astype(np.int32) + 1 for w in self.words]
        self.wide = 1 << min(14, (len(self.vocabulary) + 1).bit_length())  # words that a sampled step admits, by low bits
        classes = size_classes(self.length)
        #: of each table: the classes that admit a word at the first sampled step, as bits, by that step
        self.first: list[dict[int, np.ndarray]] = [{} for _ in range(TABLES)]
        self.tables: list[list[tuple]] = [[] for _ in range(TABLES)]
        seen_of = [[path.step(j, np.zeros(1, np.int64))[0] for path in walks(w) for j in range(int(1.6 * max(1, len(w))) + PERIOD)] for w in self.words]
        for c, (size, items) in enumerate(classes):
            steps = sampled_steps(size)
            for t in range(TABLES):
                found = []
                for i in items:
                    number, span = self.numbers[i], int(1.6 * max(1, len(self.words[i]))) + PERIOD
                    at = [seen_of[i][(t % WALKS) * span + int(j)] for j in steps[t]]
                    if max(at) < len(number):
                        seen = [int(number[x]) for x in at]
                        found.append((self._key(seen), int(i), seen))
                if not found:
                    continue
                found.sort()
                admitted = np.zeros((SAMPLES, self.wide), dtype=bool)
                for _, _, seen in found:
                    admitted[np.arange(SAMPLES), np.array(seen) & (self.wide - 1)] = True
                bits = self.first[t].setdefault(int(steps[t, 0]), np.zeros(self.wide, dtype=np.uint64))
                bits |= admitted[0].astype(np.uint64) << np.uint64(c)
                self.tables[t].append((c, steps[t], admitted, np.array([x[0] for x in found], dtype=np.uint64), np.array([x[1] for x in found], dtype=np.int64)))

    @staticmethod
    def _key(seen: list[int]) -> int:
        """The sampled words as one number, as `candidates` makes it."""
        key = seen[0]
        for x in seen[1:]:
            key = int(textbuf.mix(np.array([key], dtype=np.uint64))[0]) ^ x
        return key

    def numbered(self, h: np.ndarray) -> np.ndarray:
        """The numbers of words, and 0 for the end."""
        out = np.zeros(len(h) + 1, dtype=np.int32)
        if not len(self.vocabulary):
            return out
        guess = self.slots[(h & self.mask).astype(np.int64)]
        several = np.flatnonzero(guess < 0)
        guess[several] = np.minimum(np.searchsorted(self.vocabulary, h[several]), len(self.vocabulary) - 1) + 1
        out[:-1] = np.where(self.vocabulary[np.maximum(guess - 1, 0)] == h, guess, 0)
        return out

    def candidates(self, h: np.ndarray, number: np.ndarray, starts: int) -> np.ndarray:
        """(start, item) of the windows, among the first `starts` words, that share a bucket with an item."""
        paths, out, low = walks(h), [], self.wide - 1
        for t, tables in enumerate(self.tables):
            path, some = paths[t % WALKS], {}
            for j, bits in self.first[t].items():
                seen = number.take(path.step(j)[:starts], mode="clip")
                fits = bits.take(seen if low >= len(self.vocabulary) else seen & low, mode="clip")
                at = np.flatnonzero(fits)
                some[j] = at, seen[at], fits[at]
            for c, steps, admitted, keys, owners in tables:
                at, seen, fits = some[int(steps[0])]
                mine = np.flatnonzero(fits >> np.uint64(c) & np.uint64(1))
                at, key = at[mine], seen[mine].astype(np.uint64)
                for k in range(1, SAMPLES):
                    seen = number.take(path.step(int(steps[k]), at), mode="clip")
                    ok = np.flatnonzero(admitted[k].take(seen & low, mode="clip"))
                    at, key = at[ok], textbuf.mix(key[ok]) ^ seen[ok].astype(np.uint64)
                left, right = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                n = right - left
                hit = np.flatnonzero(n)
                if len(hit):
                    owner = np.repeat(left[hit], n[hit]) + np.arange(n[hit].sum()) - np.repeat(np.cumsum(n[hit]) - n[hit], n[hit])
                    out.append(owners[owner] << 40 | np.repeat(at[hit], n[hit]))
        found = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
        return np.stack([found & ((1 << 40) - 1), found >> 40], axis=1)

    def search(self, h: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, distance, first word, words) of the best match of each row and item; h: word hashes of rows."""
        if not len(h) or not len(self.words):
            return []
        number, found = self.numbered(h), []
        ahead = int(1.6 * self.length.max()) + PERIOD
        for a in range(0, len(h), _SLICE):
            b = min(len(h), a + _SLICE + ahead)
            pairs = self.candidates(h[a:b], np.append(number[a:b], 0), min(_SLICE, len(h) - a))
            found.append(pairs + [a, 0])
        pairs = np.concatenate(found)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for i in np.unique(pairs[:, 1]):
            self._verify(int(i), np.unique(pairs[pairs[:, 1] == i, 0]), h, number, off, best)
        return [(r, i, *x) for (r, i), x in sorted(best.items())]

    def _verify(self, i: int, start: np.ndarray, h: np.ndarray, number: np.ndarray, off: np.ndarray, best: dict) -> None:
        """Exact edit distance around these starts, where enough words are the item's."""
        size, k = int(self.length[i]), int(self.allowed[i])
        row = np.searchsorted(off, start, side="right") - 1
        low, high = np.maximum(start - k, off[row]), np.minimum(start + size + k, off[row + 1])
        mine = np.zeros(len(self.vocabulary) + 1, dtype=bool)
        mine[self.numbers[i]] = True
        enough = np.empty(len(start), dtype=bool)
        for a in range(0, len(start), 4096):
            z = slice(a, a + 4096)
            grid = low[z, None] + np.arange(size + 2 * k)[None, :]
            enough[z] = (mine[number[np.minimum(grid, len(h))]] & (grid < high[z, None])).sum(axis=1) >= size - k
        done = -1
        for s, r, lo, hi in zip(start[enough].tolist(), row[enough].tolist(), low[enough].tolist(), high[enough].tolist(), strict=True):
            known = best.get((r, i))
            if hi <= done or known and known[0] == 0:
                continue
            if np.array_equal(h[s : s + size], self.words[i]) and s + size <= off[r + 1]:
                best[r, i] = min(known or (size, 0, 0), (0, int(s - off[r]), size))
                continue
            # one comparison for the starts that follow closely: this stretch and as much again
            hi = min(hi + k, int(off[r + 1]))
            d, end = edits(self.words[i], h[lo:hi])
            done = hi
            if d > k:
                continue
            _, back = edits(self.words[i][::-1], h[lo : lo + end][::-1])
            one = (d, lo + end - back - int(off[r]), back)
            best[r, i] = min(known, one) if known else one


def item_blocks(benchmark: DataFrame, rate: float = EDIT_RATE, id_col: str = "item_id", text_col: str = "text"):
    """Items in blocks of about BLOCK_ITEMS; items without a word match nothing and are left out."""
    rows = texts(benchmark, id_col, text_col).where("doc_id is not null")
    n = max(1, math.ceil(rows.count() / BLOCK_ITEMS))
    for k in range(n):
        got = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) == k).orderBy("doc_id", "text").toArrow()
        if got.num_rows:
            h, off = textbuf.words(got.column("text").combine_chunks(), textbuf.PUNCT)
            some = np.flatnonzero(np.diff(off) > 0)
            ids = got.column("doc_id").to_pylist()
            yield Items([ids[i] for i in some], [h[off[i] : off[i + 1]].copy() for i in some], rate)


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, distance, first_word, n_words.

    Words are runs of letters and digits, A-Z lower-cased; a document is contaminated by an item of L words if some
    stretch of its words is within floor(rate * L) word edits. The best stretch is given: least distance, then first.
    Null and empty texts and items, and items with a null id, match nothing; rows of a repeated or null id match one by
    one. Items of any length count, one word as well: a benchmark's owner sees to it that its items say something.
    """
    spark = docs.sparkSession
    out = None
    for block in item_blocks(benchmark, rate, item_id, item_text):
        shared = spark.sparkContext.broadcast(block)

        def find(it, shared=shared):
            items = shared.value
            for b in batches(it):
                h, off = textbuf.words(b.column("text"), textbuf.PUNCT)
                found = items.search(h, off)
                if found:
                    row, item, d, first, n = (list(x) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), pa.array([items.ids[i] for i in item], pa.int64()), pa.array(d, pa.int64()), pa.array(first, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "item_id", "distance", "first_word", "n_words"])

        part = texts(docs, id_col, text_col).mapInArrow(find, "doc_id long, item_id long, distance long, first_word long, n_words long")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "doc_id long, item_id long, distance long, first_word long, n_words long") if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, text_col: str = "text") -> DataFrame:
    """docs without contaminated documents, all columns, in one pass without a shuffle. Each row is judged by its own
    text, whatever its id; null and empty texts stay, and so do all rows where no item has a word."""
    out = docs
    for block in item_blocks(benchmark, rate):
        out = kept_rows(out, text_col, _clean(docs.sparkSession.sparkContext.broadcast(block)))
    return out


def _clean(shared):
    def clean(text: pa.Array) -> np.ndarray:
        h, off = textbuf.words(text, textbuf.PUNCT)
        ok = np.ones(len(text), dtype=bool)
        ok[[x[0] for x in shared.value.search(h, off)]] = False
        return ok

    return clean
