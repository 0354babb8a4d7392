"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some positions of a token window and ignore the others, so a window still hashes
alike after substitutions at ignored positions. Hashes of the test items' windows are joined with
those of the training texts; around each hit the item is laid over the text and compared token by
token. A text is contaminated by an item if some window of ``WINDOW`` tokens (or the whole item, if
shorter) agrees in at least ``SIMILARITY`` of its positions.

The seed index of the test items is built in blocks of ``BLOCK_TOKENS`` item tokens; each block is
sent to the tasks, which join it with a narrow pass over the texts. More test data make more
passes, not larger ones. Texts are never shuffled.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import released

#: 1: the position counts, 0: it is ignored. Six positions count in each.
MASKS = ("11010111", "1100100111", "10101010101", "111001011")
WINDOW, SIMILARITY = 13, 0.8
BLOCK_TOKENS = 200_000
#: Marks that don't count at a word's ends.
_EDGE = string.punctuation + "“”‘’«»„…–—¿¡·"
_OFFSETS = [np.array([i for i, c in enumerate(m) if c == "1"]) for m in MASKS]
_FACTORS = np.random.default_rng(20240611).integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
_BITS = 18


def normal(word: str) -> str:
    return word.lower().strip(_EDGE) or word


class _Ids(dict):
    """Token number of a raw word; 0 if no test item has it. The commonest words are remembered."""

    LIMIT = 300_000

    def __init__(self, vocab: dict[str, int]):
        super().__init__()
        self.vocab = vocab

    def __missing__(self, raw: str) -> int:
        out = self.vocab.get(normal(raw), 0)
        if len(self) < self.LIMIT:
            self[raw] = out
        return out


def masks_of(n: int) -> list[np.ndarray]:
    """The counted positions of each mask for an item of n tokens.

    Long items have MASKS. A shorter one may lose ``lost`` of its positions to substitutions: its positions are dealt
    in turn to lost + 1 masks, so one of these is untouched.
    """
    if n >= WINDOW:
        return _OFFSETS
    lost = n - int(np.ceil(SIMILARITY * n - 1e-9))
    return [np.arange(0, n - r, lost + 1) for r in range(lost + 1)]


def _codes(ids: np.ndarray, o: np.ndarray) -> np.ndarray:
    """A 20-bit code of three counted positions of every window."""
    n = max(0, len(ids) - int(o[-1]))
    a, b, c = (ids[int(o[k]) : int(o[k]) + n] for k in (0, len(o) // 2, -1))
    return ((a * 40503) ^ (b * 30011) ^ c) & 0xFFFFF


def _seeds(ids: np.ndarray, mask: int, o: np.ndarray, pairs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the windows whose counted positions all hold test-item words.

    ``pairs`` marks the codes of the test items' windows; other windows can't match and are left out.
    """
    at = np.flatnonzero(pairs[_codes(ids, o)]) if pairs is not None else np.arange(max(0, len(ids) - int(o[-1])))
    h = np.full(len(at), mask + 1, np.uint64)
    for j, k in enumerate(o):
        word = ids[at + k]
        h = (h + word.astype(np.uint64)) * _FACTORS[j]
        h ^= h >> np.uint64(29)
        if not word.all():
            at, h = at[word > 0], h[word > 0]
    return at, h


class Index:
    """Seeds of a block of test items."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.items = [(i, [normal(w) for w in (t or "").split()]) for i, t in items]
        self.vocab: dict[str, int] = {}
        self.ids = [np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], np.int64) for _, words in self.items]
        hashes, item, start = [], [], []
        numbers: dict[tuple, int] = {}
        own = [[numbers.setdefault(tuple(o.tolist()), len(numbers)) for o in masks_of(len(ids))] if len(ids) else [] for ids in self.ids]
        self.masks = [np.array(o) for o in numbers]  # of the lengths that occur
        for n, ids in enumerate(self.ids):
            for m in dict.fromkeys(own[n]):
                at, h = _seeds(ids, m, self.masks[m])
                hashes.append(h)
                item.append(np.full(len(at), n))
                start.append(at)
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        h, i, s = cat(hashes, np.uint64), cat(item, np.int64), cat(start, np.int64)
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.start = h[order], i[order], s[order]
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(self.hash >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.pairs = np.zeros((len(self.masks), 1 << 20), bool)
        for n, ids in enumerate(self.ids):
            for m in own[n]:
                self.pairs[m][_codes(ids, self.masks[m])] = True
        self.words: _Ids | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"words": None}

    def forget(self) -> None:
        """Drop the remembered words at the end of a task."""
        self.words = None

    def overlaps(self, text: str | None) -> list[tuple]:
        """(item_id, start, length, matches, item_start) of the diagonal with the most matches for each item that passes; of equal ones the first in the text."""
        raw = (text or "").split()
        if not raw or not len(self.hash):
            return []
        self.words = self.words if self.words is not None else _Ids(self.vocab)
        ids = np.fromiter(map(self.words.__getitem__, raw), np.int64, len(raw))
        found = [np.zeros((0, 2), np.int64)]
        for m, o in enumerate(self.masks):
            at, h = _seeds(ids, m, o, self.pairs[m])
            hit = self.maybe[(h >> np.uint64(64 - _BITS)).astype(np.int64)]
            at, h = at[hit], h[hit]
            low, high = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
            for k in np.flatnonzero(high > low):
                x = slice(low[k], high[k])
                found.append(np.column_stack([self.item[x], at[k] - self.start[x]]))
                if len(found) > 4096:
                    found = [np.unique(np.concatenate(found), axis=0)]
        best: dict[int, tuple] = {}
        for n, offset in np.unique(np.concatenate(found), axis=0).tolist():
            got = self._verify(n, offset, ids)
            if got and (n not in best or got[2] > best[n][2]):
                best[n] = got
        return [(self.items[n][0], *x) for n, x in best.items()]

    def _verify(self, n: int, offset: int, ids: np.ndarray) -> tuple | None:
        """The item laid over the text at an offset: the stretch of passing windows, trimmed to matches."""
        item = self.ids[n]
        a, b = max(0, -offset), min(len(item), len(ids) - offset)
        same = (item[a:b] == ids[a + offset : b + offset]).astype(np.int64)
        w = min(WINDOW, len(item))
        if b - a < w:
            return None
        total = np.concatenate([[0], np.cumsum(same)])
        good = np.flatnonzero(total[w:] - total[:-w] >= SIMILARITY * w)
        if not len(good):
            return None
        first, last = int(good[0]), int(good[-1]) + w
        hits = np.flatnonzero(same[first:last]) + first
        first, last = int(hits[0]), int(hits[-1]) + 1
        return a + offset + first, last - first, int(same[first:last].sum()), a + first


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The test items in blocks of bounded size, streamed to the driver one partition at a time."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").filter("text is not null").toLocalIterator():
        n = len(r["text"].split())
        if block and size + n > BLOCK_TOKENS:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += n
    if block:
        yield block


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, n_words, matches, item_start): the best verified overlap of each text and item.

    start and n_words count words of the text. Null and empty texts and items overlap nothing. An item of fewer than
    WINDOW words overlaps where SIMILARITY of the whole of it stands; shorter than five words, verbatim. Repeated rows
    and rows without an id have rows each; of equal overlaps of an item the first in the text is reported.
    """
    schema = "doc_id long, item_id long, start long, n_words long, matches long, item_start long"
    out = None
    for block in _blocks(benchmark):
        index = Index(block)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(d, *x) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True) for x in index.overlaps(t.as_py())]
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema.replace(" long", "").split(", "))
            index.forget()

        part = docs.select("doc_id", "text").mapInArrow(released(run), schema)
        out = part if out is None else out.union(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that no test item contaminates, columns unchanged, in one narrow pass per block."""
    for block in _blocks(benchmark):
        index = Index(block)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not index.overlaps(t.as_py()) for t in b.column("text")], pa.bool_()))
            index.forget()

        docs = docs.mapInArrow(released(run), docs.schema)
    return docs


def contaminated(found: DataFrame) -> DataFrame:
    """(doc_id, n_items) of the texts with an overlap."""
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"))
