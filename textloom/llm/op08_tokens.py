"""Token-id output: canonical length-limited Huffman blocks with bit-offset checkpoints.

Texts are tokenized once into a table of ids. Ids are counted over the whole corpus (per task, then
summed), which gives one canonical code of at most ``LIMIT`` bits. Documents are range-partitioned and sorted by id; each partition is a shard of
blocks. A block decodes alone:

    header  "THB1", documents n, ids m, checkpoints c, payload bytes p (little-endian u32, u64 x2, u32, u64)
    doc ids i64[n], null flags u8[n], ids per document u64[n], checkpoint bit offsets u64[c]
    payload codes, most significant bit first, padded with zero bytes

The blocks are rows (shard, block, first, ids, payload) of a Parquet table, so any store that Spark
reads can hold them, and a lost task rewrites only its own shard. The code lengths are a row of
their own table. Checkpoints every ``EVERY`` ids let a decoder start anywhere; the table-driven
decoder runs all of them as lanes of one array.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, release_memory, released

if TYPE_CHECKING:
    from tokenizers import Tokenizer

LIMIT, EVERY, BLOCK_IDS = 16, 256, 1 << 18
#: Bytes of text whose runs are numbered together, texts whose ids are laid out together.
SLICE, ROWS = 2 << 20, 256
HEAD = struct.Struct("<4sIQIQ")


# codes
def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal lengths under a limit, by package-merge; ids that never occur get none (0)."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) == 0:
        return out
    if len(used) == 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of this length")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    n = len(leaf)
    weights, steps = leaf, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([leaf, pairs])
        is_leaf = np.concatenate([np.ones(n, bool), np.zeros(len(pairs), bool)])
        at = np.argsort(merged, kind="stable")
        weights = merged[at]
        steps.append(is_leaf[at])
    take = 2 * n - 2
    for is_leaf in reversed(steps):
        leaves = int(is_leaf[:take].sum())
        out[order[:leaves]] += 1  # the cheapest leaves are the rarest ids
        take = 2 * (take - leaves)
    return out


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: by length, then id."""
    out, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    for n in range(1, LIMIT + 1):
        code <<= n - last
        last = n
        ids = np.flatnonzero(lengths == n)
        out[ids] = code + np.arange(len(ids), dtype=np.uint32)
        code += len(ids)
    return out


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id and length for each possible next LIMIT bits."""
    ids = np.flatnonzero(lengths)
    ids = ids[np.lexsort((ids, lengths[ids]))]
    spread = 1 << (LIMIT - lengths[ids].astype(np.int64))
    symbol, width = np.zeros(1 << LIMIT, np.uint32), np.ones(1 << LIMIT, np.uint8)
    total = int(spread.sum())
    symbol[:total], width[:total] = np.repeat(ids, spread), np.repeat(lengths[ids], spread)
    return symbol, width


def pack(ids: np.ndarray, lengths: np.ndarray, code: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Payload and checkpoint offsets of a run of ids."""
    if not len(ids):
        return b"", np.zeros(0, np.uint64)
    n = lengths[ids].astype(np.int64)
    end = np.cumsum(n)
    at = end - n
    word = at >> 4
    value = code[ids].astype(np.int64) << (32 - n - (at & 15))
    size = int(end[-1] + 15 >> 4)
    total = np.bincount(word, value >> 16, size + 1)  # a code touches two words of 16 bits; bits don't overlap, so sums are ORs
    total[1:] += np.bincount(word, value & 0xFFFF, size)[:size]
    return total.astype(">u2").tobytes()[: int(end[-1] + 7 >> 3)], at[::EVERY].astype(np.uint64)


def unpack(payload: bytes, n: int, checkpoints: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids of a payload; every checkpoint is a lane."""
    if not n:
        return np.zeros(0, np.uint32)
    symbol, width = table
    past = EVERY * LIMIT // 8 + 4  # the last lane runs on after the payload
    raw = np.concatenate([np.frombuffer(payload, np.uint8), np.zeros(past, np.uint8)]).astype(np.int32)
    three = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    at, out = checkpoints.astype(np.int64), np.empty((EVERY, len(checkpoints)), np.uint32)
    for k in range(EVERY):
        word = (three[at >> 3] >> (8 - (at & 7))) & 0xFFFF
        out[k] = symbol[word]
        at += width[word]
    return out.T.reshape(-1)[:n]


# blocks
def write_block(doc_ids: list[int | None], parts: list[np.ndarray], lengths: np.ndarray, code: np.ndarray) -> bytes:
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    payload, marks = pack(ids, lengths, code)
    head = HEAD.pack(b"THB1", len(doc_ids), len(ids), len(marks), len(payload))
    return b"".join([
        head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(),
        np.array([len(p) for p in parts], "<u8").tobytes(), marks.astype("<u8").tobytes(), payload,
    ])


def read_block(raw: bytes, table: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document of a block."""
    magic, n, m, c, p = HEAD.unpack_from(raw)
    if magic != b"THB1":
        raise ValueError("not a block")
    at = HEAD.size
    docs, at = np.frombuffer(raw, "<i8", n, at), at + 8 * n
    null, at = np.frombuffer(raw, "u1", n, at), at + n
    sizes, at = np.frombuffer(raw, "<u8", n, at), at + 8 * n
    marks, at = np.frombuffer(raw, "<u8", c, at), at + 8 * c
    ids = unpack(raw[at : at + p], m, marks, table)
    start = 0
    for d, empty, size in zip(docs.tolist(), null.tolist(), sizes.tolist(), strict=True):
        yield (None if empty else d), ids[start : start + size]
        start += size


# text to ids
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?%&*$#"
#: Runs of these characters are cut by the tokenizer into runs of letters and runs of marks, lower-cased.
_SAFE = re.compile(f"[{_LETTERS}{_MARKS}]*")
_KEYS = re.compile(f"[a-zß-öø-ÿ]+|[{_MARKS}]+")
#: Most runs: letters, then marks. Arrow cuts these.
_PLAIN, _HEAD = f"^[{_LETTERS}]*[{_MARKS}]*$", "".join(c for c in map(chr, range(256)) if re.match(f"[{_LETTERS}]", c))


def keys(run: str) -> list[str]:
    """A run between spaces and line ends as keys that are encoded independently of each other.

    The tokenizer cuts at white space and normalizes no character across it. Runs of plain letters and
    marks are cut further, as the tokenizer does; others (with apostrophes, digits, special strings,
    any other character) stay whole, marked by a zero.
    """
    return _KEYS.findall(run.lower()) if _SAFE.fullmatch(run) else ["\0" + run]


def cut(runs: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct keys of these runs, the keys of all runs one after the other as places among them, and how many each run has.

    A run of letters, then marks has two keys, either of which may be empty.
    """
    plain = pc.match_substring_regex(runs, _PLAIN)
    simple = runs.filter(plain)
    bare = pc.utf8_rtrim(simple, _MARKS)
    others = [keys(r) for r in runs.filter(pc.invert(plain)).to_pylist()]
    found = pa.concat_arrays([pc.utf8_lower(bare), pc.utf8_ltrim(simple, _HEAD), pa.array([k for ks in others for k in ks], runs.type)]).dictionary_encode()
    at, two = found.indices.to_numpy(), plain.to_numpy(zero_copy_only=False)
    sizes = np.full(len(runs), 2)
    sizes[~two] = np.fromiter(map(len, others), np.int64, len(others))
    mine, out, n = np.repeat(two, sizes), np.empty(len(at), np.int64), len(simple)
    out[mine] = np.stack([at[:n], at[n : 2 * n]], 1).ravel()
    out[~mine] = at[2 * n :]
    return found.dictionary, out, sizes


def gather(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of values one after the other, and where each ends, after a zero."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return values[np.repeat(begins - ends[:-1], sizes) + np.arange(ends[-1])], ends


class Words:
    """Kept keys and their ids: key number n has ids[starts[n]:starts[n + 1]]. LIMIT keys are kept.

    Texts are cut into runs, runs into keys, and both numbered by Arrow, so Python sees only the distinct keys of a slice.
    Keys are kept as one array beside their sorted hashes, in a third of the memory of a dict; a key found by its hash is
    compared, and of keys with equal hashes only the first is kept. Unknown words of a slice are encoded some thousands in a
    call as a text of their own, and cut where an id marks a word's end.
    """

    LIMIT, CALL = 800_000, 5_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: The same model, which finds words between spaces without regular expressions; for words that are keys.
        self.light = Tokenizer(self.tokenizer.model)
        self.light.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        every = " ".join(["a", *_HEAD.lower(), _HEAD.lower()])
        if self._encode(every).tolist() != self._encode(every, self.light).tolist():
            self.light = self.tokenizer
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.size = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.keys, self.hashes, self.numbers = pa.array([], pa.string()), np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.starts, self.ids = np.zeros(1, np.int64), np.zeros(0, "<u4")

    def __len__(self) -> int:
        return len(self.keys)

    def __iter__(self) -> Iterator[str]:
        return iter(self.keys.to_pylist())

    def _encode(self, text: str, by: Tokenizer | None = None) -> np.ndarray:
        return np.array((by or self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _encode_words(self, part: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Sizes and ids of words."""
        ids = self._encode(" ".join(part), self.light)
        stop = np.flatnonzero(self.ends[ids]) + 1
        return [(np.diff(stop, prepend=0), ids)] if len(stop) == len(part) else list(map(self._encode_key, part))

    def _encode_key(self, key: str) -> tuple[np.ndarray, np.ndarray]:
        ids = self._encode(key.removeprefix("\0"))
        return np.array([len(ids)]), ids

    def find(self, distinct: pa.Array, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of keys, -1 for unknown ones, and whether another kept key has the key's hash."""
        at = np.searchsorted(self.hashes, hashes)
        hit = np.flatnonzero(at < len(self))
        hit = hit[self.hashes[at[hit]] == hashes[hit]]
        numbers, taken = np.full(len(hashes), -1), np.zeros(len(hashes), bool)
        found = self.numbers[at[hit]]
        equal = pc.equal(self.keys.take(pa.array(found)), distinct.take(pa.array(hit))).to_numpy(zero_copy_only=False)
        numbers[hit[equal]], taken[hit[~equal]] = found[equal], True
        return numbers, taken

    def keep(self, new: pa.Array, hashes: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.numbers = np.insert(self.numbers, at, len(self) + order)
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.keys = pa.concat_arrays([self.keys, new])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, ids])

    def look_up(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of distinct keys begin, how many they are, and the ids; unknown keys are kept if there is room."""
        names = distinct.to_numpy(zero_copy_only=False).tolist()
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
        numbers, odd = self.find(distinct, hashes)
        known, unknown = np.flatnonzero(numbers >= 0), np.flatnonzero(numbers < 0)
        begins, sizes = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        at = numbers[known]
        sizes[known] = self.starts[at + 1] - self.starts[at]
        ids, ends = gather(self.ids, self.starts[at], sizes[known])
        begins[known] = ends[:-1]
        if not len(unknown):
            return begins, sizes, ids
        again = np.ones(len(unknown), bool)
        again[np.unique(hashes[unknown], return_index=True)[1]] = False
        odd[unknown] |= again | (pc.utf8_length(distinct).to_numpy()[unknown] > 64)
        plain = [i for i in unknown.tolist() if not odd[i] and names[i].isalpha()]
        rest = sorted(set(unknown.tolist()).difference(plain), key=lambda i: (odd[i], i))
        missing, order = [names[i] for i in plain], np.array(plain + rest)
        done = [x for at in range(0, len(missing), self.CALL) for x in self._encode_words(missing[at : at + self.CALL])]
        done += [self._encode_key(names[i]) for i in rest]
        sizes[order] = np.concatenate([n for n, _ in done])
        new = np.concatenate([x for _, x in done])
        stops = np.cumsum(sizes[order])
        begins[order] = len(ids) + stops - sizes[order]
        if kept := max(0, min(int((~odd[order]).sum()), self.LIMIT - len(self))):
            first = order[:kept]
            self.keep(distinct.take(pa.array(first)), hashes[first], sizes[first], new[: stops[kept - 1]])
        return begins, sizes, np.concatenate([ids, new])

    def batch(self, texts: pa.Array, kind: str = "<u4") -> Iterator[pa.Array]:
        """The ids of each text as bytes, in arrays of at most ROWS texts."""
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        numbered = lists.flatten().dictionary_encode()
        gc.disable()  # maybe hundreds of thousands of new lists, none in a cycle
        try:
            distinct, at, counts = cut(numbered.dictionary)
            begins, sizes, ids = self.look_up(distinct)
        finally:
            gc.enable()
        pool, ends = gather(ids, begins[at], sizes[at])
        pool, stops = pool.astype(kind), ends[np.concatenate([[0], np.cumsum(counts)])]
        begins, sizes = stops[:-1], np.diff(stops)
        runs = numbered.indices.to_numpy()
        stops = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        for row in range(0, len(texts), ROWS):
            stop = stops[row : row + ROWS + 1]
            at = runs[stop[0] : stop[-1]]
            ids, ends = gather(pool, begins[at], sizes[at])
            offsets = (ends[stop - stop[0]] * ids.itemsize).astype(np.int32)
            yield pa.Array.from_buffers(pa.binary(), len(stop) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(ids)])


def slices(b: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about this many bytes of a column."""
    total = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy().astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(total // limit)) + 1).tolist(), b.num_rows]
    for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
        yield b.slice(start, stop - start)


@lru_cache(maxsize=1)
def words(path: str) -> Words:
    """A worker's tokenizer, kept for all its tasks of the tokenizing stage; later stages forget it."""
    return Words(path)


def forget_words() -> None:
    words.cache_clear()
    release_memory()


@dataclass
class Codec:
    lengths: np.ndarray
    code: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.code = codes(self.lengths)


def tokenize(docs: DataFrame, path: str, vocab: int) -> DataFrame:
    """(doc_id, tie, ids): each text's ids as bytes, two for an id where the vocabulary allows it."""
    kind = "<u2" if vocab <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = words(path)
        for b in batches:
            for part in slices(b, "text", SLICE):
                at = 0
                for ids in w.batch(part.column("text"), kind):
                    rows, at = part.slice(at, len(ids)), at + len(ids)
                    yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("tie"), ids], ["doc_id", "tie", "ids"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).mapInArrow(released(run), "doc_id long, tie long, ids binary")


def flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a column one row after the other, and where each row's begin and end."""
    column = column.cast(pa.large_binary())
    _, offsets, raw = column.buffers()
    stops = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    ids = np.frombuffer(raw or b"", kind, (stops[-1] - stops[0]) // np.dtype(kind).itemsize, stops[0])
    return ids, (stops - stops[0]) // ids.itemsize


def count_ids(ids: DataFrame, end: int, vocab: int) -> np.ndarray:
    """How often each id occurs, an end id for each row included; tasks send one count per id they saw."""
    kind = "<u2" if vocab <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()
        total = np.zeros(vocab, np.int64)
        for b in batches:
            ids, _ = flat(b.column("ids"), kind)
            for i in range(0, len(ids), BLOCK_IDS):
                total += np.bincount(ids[i : i + BLOCK_IDS], minlength=vocab)
            total[end] += b.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    out = np.zeros(vocab, np.int64)
    for r in ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def write(docs: DataFrame, path: str, scratch: Scratch, end: int = 1) -> tuple[DataFrame, DataFrame]:
    """Encode (doc_id, text) and write it; returns the blocks table and the one-row code table.

    Every text gets the end id. Rows are in ascending doc_id order, null ids first; rows of equal
    id are ordered by a hash of their text, which also lets a very frequent id span partitions.
    """
    from tokenizers import Tokenizer

    vocab = Tokenizer.from_file(path).get_vocab_size()
    kind = "<u2" if vocab <= 1 << 16 else "<u4"
    table = scratch.save(tokenize(docs, path, vocab), "ids", compression="zstd")
    codec = Codec(code_lengths(count_ids(table, end, vocab)))
    spark = docs.sparkSession
    code_table = scratch.save(spark.createDataFrame([(codec.lengths.tobytes(), LIMIT)], "lengths binary, limit int"), "code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        forget_words()
        shard, stop = TaskContext.get().partitionId(), np.array([end], kind).tobytes()
        block, first, held, docs_in, parts = 0, 0, 0, [], []

        def out() -> pa.RecordBatch:
            raw = write_block(docs_in, parts, codec.lengths, codec.code)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([held], pa.int64()), pa.array([raw], pa.binary())], ["shard", "block", "first", "ids", "payload"])

        for b in batches:
            for d, raw in zip(b.column("doc_id").to_pylist(), b.column("ids"), strict=True):
                ids = np.frombuffer(raw.as_py() + stop, kind)
                docs_in.append(d)
                parts.append(ids)
                held += len(ids)
                if held >= BLOCK_IDS:
                    yield out()
                    block, first, held, docs_in, parts = block + 1, first + held, 0, [], []
        if docs_in:
            yield out()
        release_memory()

    dealt = table.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    blocks = dealt.drop("tie").mapInArrow(run, "shard int, block int, first long, ids long, payload binary")
    out = scratch.save(blocks, "blocks")
    scratch.drop(table)
    return out, code_table


def read(blocks: DataFrame, code_table: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) decoded from the files.

    Shards follow each other in id order; a shard's offset is the sum of those before it (one number
    per shard on the driver).
    """
    lengths = np.frombuffer(code_table.first()["lengths"], np.uint8)
    sizes = sorted((r["shard"], r["n"]) for r in blocks.groupBy("shard").agg(F.sum("ids").alias("n")).collect())
    start, at = {}, 0
    for s, n in sizes:
        start[s], at = at, at + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths)
        for b in batches:
            for shard, first, raw in zip(b.column("shard").to_pylist(), b.column("first").to_pylist(), b.column("payload"), strict=True):
                at, rows = start[shard] + first, []
                for d, ids in read_block(raw.as_py(), table):
                    rows.append((d, at, len(ids), zlib.crc32(ids.astype("<u4", copy=False))))
                    at += len(ids)
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])
        release_memory()

    return blocks.select("shard", "first", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
