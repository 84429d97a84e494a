"""Language-model scoring by logistic context mixing over hashed contexts.

A text is its words, A-Z folded, each followed by a space, then an end mark. A byte is told by the decisions on its way
down the Huffman tree of the byte before it. Every decision is predicted by several hashed contexts; their predictions,
in the logistic domain, are summed under weights that a gate selects (depth in the tree, and how much the two longest
contexts have seen), and an adaptive map refines the sum by its own record. Two such mixers share the work:

* ``opening``: how a word begins, or the end: the first OPENING decisions, by contexts that cross words: the end of the word
  before, all of it, and the two words before. Along each text, block by block, what it has shown so far corrects how far predictions are trusted.
* ``rest``: a word's other decisions, by contexts within the word: two, three and four bytes, and the whole word so far.

A text is cut into segments of about SEGMENT words where a hash of two neighbouring words says so. If the segment before
occurs in other training texts, the model also knows what followed it there most often. The segment is told by a mixture:
the probability that it is that follower (a record of how often this came true, by the counts) and else the mixers'.

Contexts carry a class, one of the most frequent values of a column of the training rows (languages). A text to score has no
class: byte pairs of all its words choose the most probable one, and naming it is part of the code. So the sum of
log2 p over everything is an exact code length: total bits, and bits a byte. A training text is scored as if unseen:
each of its own occurrences is taken out of the counts that predict it.

Word counts, slots, weights and followers come from all training texts. A slot table has a fixed greatest size, beyond which
contexts share slots; followers and rare words reach the texts by joins.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm.base import mapped, merged, remainder, written

#: The end of a text among the words: a word is never empty.
END = b""
#: Words whose counts and costs go to all executors; others meet theirs by a join. The bound changes no result.
HEAD_WORDS = 1 << 17
#: Classes beside the one of all other rows.
MAX_CLASSES = 15
#: Powers of two: slots of the end of the word before, of all of it, and of the two words before.
OPENING_SLOTS = (18, 19, 20)
#: The same of two, three and four bytes and of the whole word so far; they grow with the distinct training words by up to MORE.
REST_SLOTS = (18, 19, 19, 21)
MORE = 3
WORD_SLOTS = 2
SEGMENT = 32
#: Decisions of a word that are predicted by what stands before it.
OPENING = 3
#: Texts that a scorer takes at once, so that its arrays stay in the caches.
TOGETHER = 500
BLOCK = 128
GATES = 8 * 4 * 4
BUCKETS = 33
CHUNK = 1 << 14
_EXACT = 24
_U = np.uint64
_MULT, _HALF = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)


def _levels() -> np.ndarray:
    """Counts are kept as one of 64 levels: exact up to _EXACT, then a geometric scale."""
    top = np.round(_EXACT * 1.42 ** np.arange(1, 64 - _EXACT)).astype(np.int64)
    return np.concatenate([np.arange(_EXACT + 1), top]).astype(np.float64)


LEVEL_VALUES = _levels()


def cells_of(totals: np.ndarray) -> np.ndarray:
    """The cells of (zeros, ones): where one is above the top level both are scaled, so that their ratio survives."""
    top = totals.max(axis=1, initial=0, keepdims=True)
    scaled = np.where(totals > 0, np.maximum(totals * (LEVEL_VALUES[-1] / np.maximum(top, LEVEL_VALUES[-1])), 1), 0)
    level = (np.searchsorted(LEVEL_VALUES, scaled + 1e-6 * scaled, side="right") - 1).astype(np.uint16)
    return level[:, 0] << 6 | level[:, 1]


_ZEROS, _ONES = np.divmod(np.arange(4096), 64)  # a cell is the level of zeros * 64 + the level of ones
STRETCH = np.clip(np.log((LEVEL_VALUES[_ONES] + 0.4) / (LEVEL_VALUES[_ZEROS] + 0.4)), -9, 9).astype(np.float32)
_SEEN = (1, 4, 32)
_less = lambda level: np.where((level > 0) & (level <= _EXACT), level - 1, level)
#: A cell as if one zero, or one one, had not been seen (exact levels only), and as it is.
_WITHOUT = np.concatenate([_less(_ZEROS) << 6 | _ONES, _ZEROS << 6 | _less(_ONES), _ZEROS << 6 | _ONES]).astype(np.uint16)
_AS_IS = 2
#: The same as inputs and as how much has been seen.
_INPUT, _CONFIDENCE = STRETCH[_WITHOUT], np.digitize(LEVEL_VALUES[_WITHOUT >> 6] + LEVEL_VALUES[_WITHOUT & 63], _SEEN)


def _take(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.take(table, at, mode="clip")


@dataclass
class Trees:
    """Ways from the root to each byte, for each byte that may come before."""

    start: np.ndarray
    length: np.ndarray
    node: np.ndarray
    bit: np.ndarray

    @classmethod
    def of(cls, pairs: np.ndarray) -> Trees:
        """From the counts of byte pairs, 256 by 256. Bytes never seen have ways as well; so do those behind them."""
        single = pairs.sum(axis=0) + 0.01
        start, length, node, bit = np.zeros(65536, np.intp), np.zeros(65536, np.intp), [], []
        common = None
        for before in range(256):
            if not pairs[before].any() and common is not None:
                start[before << 8 : before + 1 << 8], length[before << 8 : before + 1 << 8] = common
                continue
            tree = before if pairs[before].any() else 256
            for byte, way in enumerate(_ways(pairs[before] + 0.01 * single / single.sum() if tree < 256 else single)):
                start[before << 8 | byte], length[before << 8 | byte] = len(node), len(way)
                node += [tree << 8 | n for n, _ in way]
                bit += [b for _, b in way]
            if tree == 256:
                common = start[before << 8 : before + 1 << 8].copy(), length[before << 8 : before + 1 << 8].copy()
        return cls(start, length, np.array(node, np.uint32), np.array(bit, np.uint8))

    def decisions(self, pair: np.ndarray, limit: int | None = None, skip: np.ndarray | None = None):
        """(first, owner, node, bit, depth) of the decisions, up to ``limit`` of each byte or but the first ``skip`` of each: the
        first of each byte, and to which byte each belongs."""
        length = _take(self.length, pair)
        if limit is not None:
            length = np.minimum(length, limit)
        if skip is not None:
            length = np.maximum(length - skip, 0)
        first = np.cumsum(length) - length
        owner = np.repeat(np.arange(len(pair)), length)
        depth = np.arange(len(owner)) - _take(first if skip is None else first - skip, owner)
        at = _take(_take(self.start, pair), owner) + depth
        return first, owner, _take(self.node, at), _take(self.bit, at), np.minimum(depth, 7)


def _ways(weights: np.ndarray) -> list[list[tuple[int, int]]]:
    """Huffman: for each symbol the (node, bit) from the root on."""
    heap = [(float(w), i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    up: dict[int, tuple[int, int]] = {}
    new = len(heap)
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        up[i], up[j] = (new, 0), (new, 1)
        heapq.heappush(heap, (a + b, new))
        new += 1
    out = []
    for i in range(len(weights)):
        way = []
        while i in up:
            i, b = up[i]
            way.append((i - len(weights), b))
        out.append(way[::-1])
    return out


def slots_of(sizes: tuple[int, ...], keys: list[np.ndarray], owner: np.ndarray, node: np.ndarray) -> np.ndarray:
    """A row of slots for each context: hashes of its key (32 bits a byte) and of the node."""
    told = node * np.uint32(0x9E3779B1)
    out = np.empty((len(sizes), len(owner)), np.intp)
    low = 0
    for row, size, key in zip(out, sizes, keys):
        h = _take(key, owner)
        h ^= told
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0xC2B2AE35)
        h >>= np.uint32(32 - size)
        np.add(h, low, out=row, casting="unsafe")
        low += 1 << size
    return out


def _bucket(x: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Depth of the decision and the prediction on a scale, as one number."""
    return depth * BUCKETS + np.clip(x * 2 + (BUCKETS // 2 + 0.5), 0, BUCKETS - 1).astype(np.intp)


def _chance(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


def _nats(x: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """-ln p of the bits."""
    x = np.clip(x, -16, 16)
    return np.log(1 + np.exp(np.where(bit, -x, x)))


@dataclass
class Mixer:
    sizes: tuple[int, ...]
    cells: np.ndarray
    weights: np.ndarray
    refine: np.ndarray

    @classmethod
    def new(cls, sizes: tuple[int, ...], cells: np.ndarray | None = None) -> Mixer:
        """Without counts (a table of no use), weights and refinement as before learning."""
        return cls(sizes, np.zeros(0, np.uint16) if cells is None else cells, np.full((len(sizes) + 1, GATES), 0.3, np.float32), np.zeros(8 * BUCKETS, np.float32))

    def seen(self, slots: np.ndarray, mode: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The inputs and how much the two longest contexts have seen; ``mode`` is the bit to take out, or _AS_IS."""
        cells = _take(self.cells, slots)
        cells += mode.astype(np.uint16) << np.uint16(12)
        return _take(_INPUT, cells), _take(_CONFIDENCE, cells[-2]), _take(_CONFIDENCE, cells[-1])

    def mixed(self, inputs: np.ndarray, second: np.ndarray, longest: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gates = depth << 4 | second << 2 | longest
        x = _take(self.weights[-1], gates)
        for w, given in zip(self.weights, inputs):
            x += _take(w, gates) * given
        return x, gates

    def learn(self, inputs: np.ndarray, x: np.ndarray, gates: np.ndarray, bit: np.ndarray, n: np.ndarray | float, rate: float = 0.05) -> None:
        """One online step, scaled by the inputs' squares."""
        error = (bit - _chance(x)) * n
        for i in range(len(self.weights)):
            given = inputs[i] if i < len(inputs) else np.ones_like(error)
            gradient, scale = np.bincount(gates, error * given, GATES), np.bincount(gates, n * given * given, GATES)
            self.weights[i] += (rate * gradient / (scale / 10 + 50)).astype(np.float32)


# Texts and words as arrays


_POWERS = [np.ones(1, np.uint64)]


def _power(n: int) -> np.ndarray:
    """The powers of an odd number modulo 2**64, n of them or more."""
    if len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            _POWERS[0] = np.cumprod(np.full(2 * n, _U(0x100000001B3)), dtype=np.uint64)
    return _POWERS[0]


def _bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary array without nulls, and the words' sizes."""
    bounds = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] else np.zeros(0, np.uint8)
    return data, np.diff(bounds).astype(np.int64)


def _place(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the runs of these sizes."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _hashes(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64 bits of each word, of eight bytes at a time; none is empty."""
    padded = np.zeros(len(data) // 8 * 8 + 16, np.uint8)
    padded[: len(data)] = data
    eights, starts = padded.view("<u8"), np.cumsum(sizes) - sizes
    h = sizes.astype(np.uint64) * _HALF
    long = np.flatnonzero(sizes > 64)
    for i in long.tolist():
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + sizes[i]].tobytes())
    left, at, size = None, starts, sizes  # all
    with np.errstate(over="ignore"):
        for k in range(8):
            shift = (at & 7).astype(np.uint64) << _U(3)
            v = _take(eights, at >> 3) >> shift | _take(eights, (at >> 3) + 1) << (_U(63) - shift) << _U(1)
            cut = _U(64) - (np.minimum(size, 8) << 3).astype(np.uint64)
            v = ((h if left is None else h[left]) ^ (v << cut >> cut)) * _MULT
            v ^= v >> _U(29)
            if left is None:
                v[long] = h[long]
                h = v
            else:
                h[left] = v
            more = np.flatnonzero((size > 8) & (size <= 64 - 8 * k))
            left, at, size = more if left is None else left[more], at[more] + 8, size[more] - 8
            if not len(left):
                break
        return h * _HALF


@dataclass
class Words:
    """Words in bytes; ``octets`` are those of each with its space (of END: a space alone)."""

    octets: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    pair: np.ndarray

    @classmethod
    def of(cls, words: pa.Array) -> Words:
        """Of a binary array without nulls; END is the empty word."""
        data, sizes = _bytes(words)
        sizes = sizes + 1
        starts = np.cumsum(sizes) - sizes
        octets = np.full(int(sizes.sum()), 32, np.uint8)
        octets[np.arange(len(data)) + np.repeat(np.arange(len(words)), sizes - 1)] = data
        before = np.empty_like(octets)
        before[1:] = octets[:-1]
        before[starts] = 32
        return cls(octets, starts, sizes, before.astype(np.intp) << 8 | octets)

    def inner_keys(self, classes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """(keys of the inner contexts, pairs, word, decisions told before) of each byte."""
        word = np.repeat(np.arange(len(self.sizes)), self.sizes)
        place = np.arange(len(self.octets)) - self.starts[word] if len(word) else word
        raw = self.octets.astype(np.uint64)
        own = np.asarray(classes, np.uint64)[word] << _U(48) if len(word) else np.zeros(0, np.uint64)
        keys, so_far = [], np.zeros(len(raw), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(1, 5):
                b = np.full(len(raw), 32, np.uint64)
                b[k:] = raw[:-k]
                b[place < k] = 32
                so_far = so_far | b << _U(8 * (k - 1))
                if k > 1:  # one byte says no more than the tree itself
                    keys.append(_fold(so_far | own, k))
            terms = (raw + _U(1)) * _power(int(self.sizes.max(initial=0)))[place]
            before = np.cumsum(terms, dtype=np.uint64) - terms
            prefix = (before - before[self.starts[word]]) * _MULT + place.astype(np.uint64) if len(raw) else before
            keys.append(_fold(prefix ^ own * _MULT, 5))
        return keys, self.pair, word, np.where(place == 0, OPENING, 0)


def _fold(key: np.ndarray, i: int) -> np.ndarray:
    """A 32-bit hash."""
    with np.errstate(over="ignore"):
        h = (key + _U(i)) * _MULT
        h ^= h >> _U(32)
        return (h * _HALF >> _U(32)).astype(np.uint32)


@dataclass
class Texts:
    """Texts of a batch, word after word, END after each text's last. ``text`` and ``place`` say where a word stands, ``words``
    are those beside END, at ``at``; ``ending`` is a word's last two bytes and its length, as one number."""

    words: pa.Array
    at: np.ndarray
    starts: np.ndarray
    text: np.ndarray
    place: np.ndarray
    hashes: np.ndarray
    ending: np.ndarray
    first: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Texts:
        """Of a binary array; a null is empty."""
        words, owner = split(texts)
        per = np.bincount(owner, minlength=len(texts)) + 1
        starts = np.cumsum(per) - per
        n, at = int(per.sum()), np.arange(len(owner)) + owner
        data, sizes = _bytes(words)
        last = np.cumsum(sizes) - 1

        def laid(values: np.ndarray, end: int, kind: type) -> np.ndarray:
            out = np.full(n, end, kind)
            out[at] = values
            return out

        before = np.where(sizes > 1, _take(data, np.maximum(last - 1, 0)), 0) if len(data) else data
        ending = data[last].astype(np.uint32) | before.astype(np.uint32) << np.uint32(8) | np.minimum(sizes, 15).astype(np.uint32) << np.uint32(16)
        return cls(
            words, at, starts, np.repeat(np.arange(len(texts)), per), _place(per), laid(_hashes(data, sizes), 1, np.uint64),
            laid(ending, 0, np.uint32), laid(data[last - sizes + 1], 32, np.uint8), laid(sizes + 1, 1, np.int64),
        )

    def opening(self, classes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """(keys, pairs) of each word's first byte, ``classes`` being those of the texts."""
        own = np.asarray(classes, np.uint64)[self.text] if len(self.text) else np.zeros(0, np.uint64)

        def back(values: np.ndarray, k: int) -> np.ndarray:
            out = np.zeros(len(values), np.uint64)
            out[k:] = values[:-k]
            out[self.place < k] = 0
            return out

        with np.errstate(over="ignore"):
            one = back(self.hashes, 1)
            keys = [_fold(back(self.ending, 1) | own << _U(32), 12), _fold(one ^ own * _MULT, 13), _fold(one * _HALF + back(self.hashes, 2), 14)]
        return keys, (32 << 8) | self.first.astype(np.intp)

    def segments(self, every: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the segments; each text begins one."""
        hashes = self.hashes
        cut = self.place == 0
        with np.errstate(over="ignore"):
            two = (hashes[:-1] * _MULT ^ hashes[1:]) * _HALF
            cut[1:] |= (two >> _U(32)) % _U(every) == 0
            starts = np.flatnonzero(cut)
            place = _place(np.diff(starts, append=len(hashes)))
            sums = np.add.reduceat(hashes * _power(int(place.max(initial=0)) + 1)[place], starts) if len(starts) else np.zeros(0, np.uint64)
            sums ^= sums >> _U(31)
        return starts, sums * _MULT


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (binary) of a binary array, lower-cased, and the text of each; a null is empty."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, b"").view(pa.string())))
    owner, flat = pc.list_parent_indices(parts), parts.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(real).view(pa.binary()), owner.filter(real).to_numpy().astype(np.int64)


# Training


def word_counts(training: DataFrame, classes: int) -> DataFrame:
    """(word, n, n0, n1, ...): the occurrences of each word in all texts of rows (class, text) and in those of each class;
    the end of each text is the word END."""

    def run(batches):
        for batch in merged(batches, 4000):
            label = batch.column(0).to_numpy(zero_copy_only=False)
            for k in np.unique(label).tolist():
                texts = batch.column(1).filter(pa.array(label == k))
                coded = split(texts)[0].dictionary_encode()
                n = np.append(np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)), len(texts))
                words = pa.concat_arrays([coded.dictionary, pa.array([END], pa.binary())])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), k), pa.int32()), words, pa.array(n, pa.int64())], ["class", "word", "n"])

    each = [F.sum(F.when(F.col("class") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(classes)]
    return mapped(training, run, "class int, word binary, n long").groupBy("word").agg(F.sum("n").alias("n"), *each)


def _by_class(batches, size: int = 20_000):
    """(words, classes, counts) of rows (word, n, n0, n1, ...), a row for each class that has the word."""
    for batch in merged(batches, size):
        counts = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]])
        k, row = np.nonzero(counts)
        for lo in range(0, len(k), size):
            part = slice(lo, lo + size)
            yield batch.column(0).take(pa.array(row[part])), k[part], counts[k[part], row[part]]


def byte_pairs(words: DataFrame, classes: int) -> np.ndarray:
    """How often each class has each pair of bytes: at most 65,536 numbers a class reach the driver."""

    def run(batches):
        table = np.zeros((classes, 65536), np.int64)
        for group, k, n in _by_class(batches):
            w = Words.of(group)
            np.add.at(table, (np.repeat(k, w.sizes), w.pair), np.repeat(n, w.sizes))
        k, pair = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(pair, pa.int32()), pa.array(table[k, pair])], ["k", "pair", "n"])

    got = mapped(words, run, "k int, pair int, n long").groupBy("k", "pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((classes, 65536))
    out[got.column("k").to_numpy(), got.column("pair").to_numpy()] = got.column("n").to_numpy()
    return out


class SlotTable:
    """Zeros and ones of each slot; ``flush`` gives rows (chunk, data) and starts anew, before a number overflows."""

    def __init__(self, sizes: tuple[int, ...]):
        self.slots, self.pairs, self.numbers, self.total = sum(1 << s for s in sizes), None, None, 0

    def add(self, slots: np.ndarray, bit: np.ndarray, n: np.ndarray | None = None):
        """Rows to pass on; ``n`` are weights of under 2**31 each."""
        added = len(bit) if n is None else int(n.sum())
        if self.pairs is not None and self.total + added >= 1 << 32:
            yield from self.flush()
        if self.pairs is None:
            self.pairs = np.zeros(self.slots, np.uint64)
            self.numbers = self.pairs.view(np.uint32)
        self.total += added
        weight = np.ones(len(bit), np.uint32) if n is None else n.astype(np.uint32)
        for row in slots:  # flat arrays of these types take the fast path of add.at
            np.add.at(self.numbers, row * 2 + bit, weight)

    def flush(self):
        if self.pairs is not None:
            for c in range(0, self.slots, CHUNK):
                part = self.pairs[c : c + CHUNK]
                if part.any():
                    yield _chunk(c // CHUNK, part)
            self.pairs, self.numbers, self.total = None, None, 0


def _chunk(number: int, data: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([packed(data)], pa.binary())], ["chunk", "data"])


def packed(data: np.ndarray) -> bytes:
    """Compressed, with the size in front."""
    return data.nbytes.to_bytes(8, "little") + pa.compress(data.tobytes(), codec="lz4", asbytes=True)


def unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="lz4", asbytes=True), kind)


def _gathered(rows: DataFrame, slots: int) -> tuple[np.ndarray, np.ndarray | None]:
    """The cells, and the sum of the arrays of chunk -1, of rows (chunk, data)."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = unpacked(data, np.uint32).astype(np.uint64) if c >= 0 else unpacked(data, np.float64)
                sums[c] = sums[c] + part if c in sums else part
        for c, total in sums.items():
            yield _chunk(c, cells_of(total.reshape(-1, 2)).astype("<u2") if c >= 0 else total)

    cells, numbers = np.zeros(slots, np.uint16), None
    for row in mapped(rows.repartition("chunk"), add, "chunk long, data binary").toArrow().to_pylist():
        if row["chunk"] < 0:
            numbers = unpacked(row["data"], np.float64)
        else:
            part = unpacked(row["data"], "<u2")
            cells[row["chunk"] * CHUNK : row["chunk"] * CHUNK + len(part)] = part
    return cells, numbers


def _rest_parts(group: pa.Array, classes: np.ndarray, sizes: tuple[int, ...], trees: Trees, step: int = 2_000):
    """(lo, words' place of each byte, first, owner, slots, bit, depth) of ``step`` words at a time."""
    for lo in range(0, len(group), step):
        keys, pair, word, told = Words.of(group[lo : lo + step]).inner_keys(classes[lo : lo + step])
        first, owner, node, bit, depth = trees.decisions(pair, skip=told)
        yield lo, word, first, owner, slots_of(sizes, keys, owner, node), bit, depth


def rest_costs(mixer: Mixer, trees: Trees, group: pa.Array, classes: np.ndarray, unseen: np.ndarray) -> np.ndarray:
    """log10 of the probability of what follows the opening of each word, in its class; ``unseen`` marks the words of
    which one occurrence is taken out of the counts."""
    out = np.zeros(len(group))
    for lo, word, first, owner, slots, bit, depth in _rest_parts(group, classes, mixer.sizes, trees):
        at = _take(word, owner) + lo
        x, _ = mixer.mixed(*mixer.seen(slots, np.where(unseen[at], bit, _AS_IS)), depth)
        x += _take(mixer.refine, _bucket(x, depth))
        out += np.bincount(at, _nats(x, bit), len(group))
    return out / -np.log(10)


def fit_rest(words: DataFrame, trees: Trees, distinct: int) -> Mixer:
    """From the counts of all training words (a written table: it is read thrice)."""
    context = words.sparkSession.sparkContext
    more = min(MORE, max(0, (-(-WORD_SLOTS * distinct >> REST_SLOTS[-1]) - 1).bit_length()))
    sizes = tuple(s + more for s in REST_SLOTS)
    shared_trees = context.broadcast(trees)

    def count(batches):
        table = SlotTable(sizes)
        for group, classes, n in _by_class(batches):
            for lo, word, _, owner, slots, bit, _ in _rest_parts(group, classes, sizes, shared_trees.value):
                left = n[lo : lo + 2_000]
                while left.any():  # weights of one go stay far below what a slot can hold
                    now = np.minimum(left, (1 << 30) // len(bit) + 1)
                    yield from table.add(slots, bit, now[_take(word, owner)])
                    left = left - now
        yield from table.flush()

    mixer = Mixer.new(sizes, _gathered(mapped(words, count, "chunk long, data binary"), sum(1 << s for s in sizes))[0])
    shared = context.broadcast(mixer)

    def learn(batches):
        own, seen = Mixer(sizes, shared.value.cells, shared.value.weights.copy(), shared.value.refine), 0.0
        for group, classes, n in _by_class(batches):
            for lo, word, _, owner, slots, bit, depth in _rest_parts(group, classes, sizes, shared_trees.value, step=500):
                inputs, *conf = own.seen(slots, bit)
                own.learn(inputs, *own.mixed(inputs, *conf, depth), bit, n[lo : lo + 500].astype(np.float32)[_take(word, owner)])
            seen += float(n.sum())
        if seen:
            yield _numbers(seen, own.weights.reshape(-1) * seen)

    # dealt by word and in order, so that what is learned does not hang on how the table happens to lie in files
    got = _summed(words.repartition(32, "word").sortWithinPartitions("word"), learn)
    if got is not None:
        mixer.weights = (got[1:] / got[0]).reshape(mixer.weights.shape).astype(np.float32)
    weights = context.broadcast(mixer.weights)

    def residuals(batches):
        own, out = Mixer(sizes, shared.value.cells, weights.value, shared.value.refine), np.zeros((3, 8 * BUCKETS))
        for group, classes, n in _by_class(batches):
            for lo, word, _, owner, slots, bit, depth in _rest_parts(group, classes, sizes, shared_trees.value):
                x, _ = own.mixed(*own.seen(slots, bit), depth)
                at, k = _bucket(x, depth), n[lo : lo + 2_000].astype(np.float64)[_take(word, owner)]
                for row, v in zip(out, (k, k * bit, k * _chance(x))):
                    row += np.bincount(at, v, 8 * BUCKETS)
        yield _numbers(0.0, out.reshape(-1))

    got = _summed(words, residuals)
    mixer.refine = _refinement(got[1:] if got is not None else np.zeros(24 * BUCKETS))
    for used in (shared, shared_trees, weights):  # what is learned goes out once more, with all the scorer needs
        used.destroy()
    return mixer


def _refinement(record: np.ndarray) -> np.ndarray:
    """What to add to predictions, from the record: for each bucket decisions, ones, and the sum of the predictions."""
    n, ones, predicted = record.reshape(3, -1)
    fit_to, fit_from = (ones + 0.5) / (n + 1), (predicted + 0.5) / (n + 1)
    return (np.log(fit_to / (1 - fit_to)) - np.log(fit_from / (1 - fit_from))).astype(np.float32)


def fit_opening(training: DataFrame, trees: Trees, step: int = 16_000) -> Mixer:
    """One pass over all training texts in the order of their partitions: every decision is predicted from what the partition
    has shown before, weights and the map's record are learned from it online, then it is counted. Counts are summed,
    weights averaged by what each partition has seen."""
    context = training.sparkSession.sparkContext
    shared = context.broadcast(trees)
    width = len(OPENING_SLOTS) + 1

    def run(batches):
        mixer, table, seen, record = Mixer.new(OPENING_SLOTS), SlotTable(OPENING_SLOTS), 0.0, np.zeros((3, 8 * BUCKETS))
        for batch in (whole.slice(lo, TOGETHER) for whole in batches for lo in range(0, whole.num_rows, TOGETHER)):
            t = Texts.of(batch.column(1))
            keys, pair = t.opening(batch.column(0).to_numpy(zero_copy_only=False))
            for lo in range(0, len(pair), step):
                _, owner, node, bit, depth = shared.value.decisions(pair[lo : lo + step], OPENING)
                slots = slots_of(OPENING_SLOTS, [k[lo : lo + step] for k in keys], owner, node)
                if table.pairs is not None:
                    both = _take(table.pairs, slots)
                    ones, zeros = (both >> _U(32)).astype(np.float32), (both & _U(0xFFFFFFFF)).astype(np.float32)
                    inputs = np.clip(np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4))), -9, 9)
                    x, gates = mixer.mixed(inputs, *(np.digitize(ones[i] + zeros[i], _SEEN) for i in (-2, -1)), depth)
                    at = _bucket(x, depth)
                    for row, v in zip(record, (None, bit, _chance(x))):
                        row += np.bincount(at, v, 8 * BUCKETS)
                    mixer.learn(inputs, x, gates, bit, np.float32(1))
                yield from table.add(slots, bit)
            seen += len(pair)
        if seen:
            yield _chunk(-1, np.concatenate([[seen], mixer.weights.reshape(-1) * seen, record.reshape(-1)]))
        yield from table.flush()

    cells, got = _gathered(mapped(training, run, "chunk long, data binary"), sum(1 << s for s in OPENING_SLOTS))
    shared.destroy()
    mixer = Mixer.new(OPENING_SLOTS, cells)
    if got is not None:
        mixer.weights = (got[1 : 1 + width * GATES] / got[0]).reshape(width, GATES).astype(np.float32)
        mixer.refine = _refinement(got[1 + width * GATES :])
    return mixer


def _numbers(first: float, rest: np.ndarray) -> pa.RecordBatch:
    values = np.append(first, rest)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values, pa.float64())], ["i", "v"])


def _summed(rows: DataFrame, function) -> np.ndarray | None:
    """The sums over all partitions of the equally many numbers that each gives."""
    got = mapped(rows, function, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    if not got.num_rows:
        return None
    out = np.zeros(got.num_rows)
    out[got.column("i").to_numpy()] = got.column("v").to_numpy()
    return out


# Scoring


def opening_costs(mixer: Mixer, trees: Trees, texts: Texts, classes: np.ndarray, unseen: np.ndarray, block: int = BLOCK, together: int = 128, rate: float = 0.2) -> np.ndarray:
    """log10 of the probability of each word's opening. After every ``block`` words each text corrects, for itself, the
    factor of its predictions; texts in their i-th block go together, and a text's result does not hang on the others."""
    keys, pair = texts.opening(classes)
    factor = np.ones(len(texts.starts), np.float32)
    out = np.zeros(len(pair))
    stage = texts.place // block
    order = np.argsort(stage, kind="stable")
    text, stage = texts.text[order], stage[order]
    new = np.flatnonzero(np.diff(text, prepend=-1) | np.diff(stage, prepend=-1))  # where a text's block begins
    bounds = [0]
    for at in [*np.searchsorted(new, np.flatnonzero(np.diff(stage, prepend=-1))).tolist(), len(new)]:  # the first of each stage
        while bounds[-1] < at:
            bounds.append(min(bounds[-1] + together, at))
    edges = np.append(new, len(order))[bounds]
    for lo, hi, a, b in zip(edges, edges[1:], bounds, bounds[1:]):
        at = order[lo:hi]
        first, owner, node, bit, depth = trees.decisions(pair[at], OPENING)
        slots = slots_of(mixer.sizes, [k[at] for k in keys], owner, node)
        inputs, *conf = mixer.seen(slots, np.where(_take(unseen[text[lo:hi]], owner), bit, np.uint8(_AS_IS)))
        x, _ = mixer.mixed(inputs, *conf, depth)
        who, begins = text[new[a:b]], first[new[a:b] - lo]
        given = x
        x = given * np.repeat(factor[who], np.diff(begins, append=len(owner)))
        x += _take(mixer.refine, _bucket(x, depth))
        out[at] = np.add.reduceat(_nats(x, bit), first)
        gradient, scale = np.add.reduceat((bit - _chance(x)) * given, begins), np.add.reduceat(given * given, begins)
        factor[who] = np.clip(factor[who] + rate * gradient / (scale / 4 + 50), 0.5, 2)
    return out / -np.log(10)


class Places:
    """Where each of some words stands, by their hashes: an open table, probed for many words at once."""

    def __init__(self, words: pa.Array):
        known = _bytes(words)
        end = known[1] == 0
        self.hashes = np.ones(len(words), np.uint64)
        self.hashes[~end] = _hashes(known[0], known[1][~end])
        self.bits = max(4, (4 * len(words)).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32)
        self.probes = 0
        left = np.arange(len(words), dtype=np.int32)
        while len(left):
            at = self._at(self.hashes[left])
            free = self.table[at] < 0
            self.table[at[free]] = left[free]  # of those that meet one stays
            left = left[self.table[at] != left]
            self.probes += 1

    def _at(self, hashes: np.ndarray, probe: int | None = None) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((hashes + _U(self.probes if probe is None else probe)) * _MULT >> _U(64 - self.bits)).astype(np.int64)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each, -1 if it is none of the words."""
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        for probe in range(self.probes):
            found = _take(self.table, self._at(hashes[left] if probe else hashes, probe))
            hit = (found >= 0) & (_take(self.hashes, np.maximum(found, 0)) == (hashes[left] if probe else hashes)) if len(self.hashes) else found >= 0
            out[left[hit]] = found[hit]
            left = left[~hit & (found >= 0)]
        return out


@dataclass
class Scorer:
    """All that scoring needs beside the joined tables. ``costs``: (as it is or unseen, class, frequent word)."""

    trees: Trees
    opening: Mixer
    rest: Mixer
    places: Places
    base: np.ndarray
    costs: np.ndarray
    classes: np.ndarray
    prior: np.ndarray
    votes: np.ndarray
    head_votes: np.ndarray

    def batch(self, texts: pa.Array, held_out: np.ndarray, every: int) -> list[pa.Array]:
        """n_tokens, head_tokens, head_base, first, coded_bytes, tail, before, segment and cost of each text."""
        t = Texts.of(texts)
        n, n_classes = len(texts), len(self.classes)
        sums = lambda v: np.add.reduceat(v, t.starts) if n else np.zeros(0)
        at = self.places.of(t.hashes)
        rare = np.flatnonzero((at < 0) & (t.sizes > 1))
        coded = t.words.take(pa.array(rare - t.text[rare])).dictionary_encode()  # as many ENDs stand before a word as texts
        code, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        w = Words.of(distinct)
        chosen, top = np.zeros(n, np.int64), np.full(n, -np.inf)
        for j in range(n_classes):
            votes = _take(self.head_votes[j], at % len(self.base)).astype(np.float64)  # -1 stands for the last, a zero
            if len(rare):
                votes[rare] = np.add.reduceat(self.votes[j][w.pair], w.starts).astype(np.float32)[code]
            votes = sums(votes) + self.prior[j]
            chosen[votes > top] = j
            top = np.maximum(top, votes)
        classes, unseen = self.classes[chosen], ~held_out
        cost = self.costs.reshape(-1)[((unseen * n_classes + chosen) * len(self.base))[t.text] + at % len(self.base)].astype(np.float64) if n else np.zeros(0)
        key, inverse = np.unique((code * n_classes + chosen[t.text[rare]]) * 2 + unseen[t.text[rare]], return_inverse=True)
        group = distinct.take(pa.array(key // (2 * n_classes)))
        cost[rare] = rest_costs(self.rest, self.trees, group, self.classes[key // 2 % n_classes], key % 2 == 1)[inverse]
        cost += opening_costs(self.opening, self.trees, t, classes, unseen)
        seg, hashes = t.segments(every)
        whole = np.add.reduceat(cost, seg) if len(seg) else np.zeros(0)
        opens = t.place[seg] == 0
        later = np.flatnonzero(~opens)
        per = np.bincount(t.text[seg[later]], minlength=n)
        offsets = pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32())
        lists = lambda v, kind: pa.ListArray.from_arrays(offsets, pa.array(v, kind))
        pairs, k = np.unique(t.text[rare] * max(1, len(distinct)) + code, return_counts=True)
        tails = np.concatenate([[0], np.cumsum(np.bincount(pairs // max(1, len(distinct)), minlength=n))])
        tail = pa.MapArray.from_arrays(pa.array(tails, pa.int32()), distinct.take(pa.array(pairs % max(1, len(distinct)))), pa.array(k, pa.int64()))
        return [
            pa.array(np.bincount(t.text, minlength=n), pa.int64()), pa.array(sums((at >= 0).astype(np.int64)), pa.int64()), pa.array(sums(_take(self.base, at % len(self.base))), pa.float64()),
            pa.array(whole[opens] + self.prior[chosen], pa.float64()), pa.array(sums(t.sizes), pa.int64()), tail,
            lists(hashes[later - 1].view(np.int64), pa.int64()), lists(hashes[later].view(np.int64), pa.int64()), lists(whole[later], pa.float32()),
        ]


SCORED = "n_tokens long, head_tokens long, head_base double, first double, coded_bytes long, tail map<binary,bigint>, before array<long>, segment array<long>, cost array<float>"
_KINDS = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.map_(pa.binary(), pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float32()))


def fit(training: DataFrame, named: list[str], head_words: int) -> tuple[Scorer, DataFrame, int, int]:
    """The scorer, the table of all training words, and the numbers of tokens and of distinct words, from rows
    (class, binary text)."""
    classes = len(named) + 1
    words = written(word_counts(training, classes), "words")
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    pairs = byte_pairs(words, classes)
    trees = Trees.of(pairs.sum(axis=0).reshape(256, 256))
    rest = fit_rest(words, trees, int(totals["v"]))
    opening = fit_opening(training, trees)
    ends = words.where(F.octet_length("word") == 0).first()
    texts = np.array([ends[f"n{k}"] if ends else 0 for k in range(classes)])
    used = np.flatnonzero(texts) if texts.any() else np.zeros(1, int)
    prior = np.log10(np.maximum(texts[used], 1) / max(1, texts.sum()))
    rows, by = (x.reshape(classes, 256, 256)[used] for x in (pairs, pairs))
    votes = np.log10((rows + 0.5) / (by.sum(axis=2, keepdims=True) + 128)).reshape(len(used), 65536).astype(np.float32)
    head = words.orderBy(F.octet_length("word") != 0, F.desc("n"), "word").limit(head_words).select("word", "n").toArrow()  # END is always one
    known = head.column("word").combine_chunks()
    known = known if isinstance(known, pa.Array) else pa.concat_arrays(known.chunks)
    costs = np.zeros((2, len(used), len(known) + 1), np.float32)  # the last: what is not frequent
    for i in range(2):
        for j, k in enumerate(used.tolist()):
            costs[i, j, :-1] = rest_costs(rest, trees, known, np.full(len(known), k), np.full(len(known), bool(i)))
    base = np.append(np.log10(head.column("n").to_numpy() + 0.5), 0.0).astype(np.float64)
    w = Words.of(known)
    head_votes = [np.append(np.add.reduceat(v[w.pair], w.starts) if len(known) else [], 0.0) for v in votes]
    return Scorer(trees, opening, rest, Places(known), base, costs, used, prior, votes, np.stack(head_votes).astype(np.float32)), words, int(totals["n"]), int(totals["v"])


def _level(count) -> F.Column:
    """Up to eight, then powers of two."""
    return F.when(count <= 8, count).otherwise(F.lit(5) + F.floor(F.log2(count))).cast("int")


def follow(scored: DataFrame, every: str = "row") -> DataFrame:
    """(row, later): the log10 probability of all segments of a text behind its first, from rows (row, held_out, trained,
    before, segment, cost). A follower that a training row itself supplies does not count for it."""
    each = scored.select("row", "trained", F.explode(F.arrays_zip("before", "segment", "cost")).alias("s")).select("row", "trained", "s.*")
    pairs = each.where("trained").groupBy("before", "segment").agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct("n", F.col("segment").alias("s")))
    followers = pairs.groupBy("before").agg(F.sum("n").alias("all"), best.alias("best")).select("before", "all", F.col("best.n").alias("top"), F.col("best.s").alias("follower"))
    followers = written(followers, "followers")  # as a table, so that a frequent segment's partition of the join can be split
    hit = F.coalesce(F.col("segment") == F.col("follower"), F.lit(False))
    own = F.col("trained").cast("long")
    met = each.join(followers, "before", "left").select(
        "row", "trained", "cost", hit.alias("hit"), (F.coalesce("all", F.lit(0)) - own).alias("all"), (F.coalesce("top", F.lit(0)) - F.when(hit, own).otherwise(0)).alias("top"),
    )
    state = F.when(F.col("all") > 0, _level(F.col("all")) * 64 + _level(F.col("top")))
    met = written(met.select("row", "trained", "cost", "hit", state.alias("state")), "met")
    record = met.where("trained and state is not null").groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"))
    chance = record.select("state", ((F.col("hits") + 0.5) / (F.col("n") + 1)).alias("p"))  # at most some thousand rows
    p = F.coalesce("p", F.lit(0.5))
    told = F.when(F.col("state").isNull(), F.col("cost")).when(F.col("hit"), F.log10(p + (1 - p) * F.pow(F.lit(10.0), F.greatest(F.col("cost"), F.lit(-300.0))))).otherwise(F.log10(1 - p) + F.col("cost"))
    return met.join(F.broadcast(chance), "state", "left").groupBy("row").agg(F.sum(told.cast("double")).alias("later"))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = "lang", held_out_mod: int = 5, head_words: int = HEAD_WORDS, segment: int = SEGMENT) -> DataFrame:
    """The id, held_out, n_tokens, n_known, train_tokens, base_score, score, and bits_per_byte of the coded text.

    Training texts are those of rows whose crc32(id) mod ``held_out_mod`` is not 1; a null id is no training text and
    not held out. Their classes are the MAX_CLASSES most frequent values of ``class_col`` (of ties the first by name); all
    other rows, those of a null value too, are one more. A null or empty text is its end alone. Very long texts are read
    whole. Repeated rows are trained on and scored each; a table without rows gives none. Other columns of ``docs``, whatever
    their names, are not read. Without any training text N and V are zero, counts are zero, and base_score is defined.
    The opening's weights are learned in the order of each partition, so scores hang a little (on tables of some hundred
    rows by some hundredths) on how rows lie in partitions; the same layout gives the same scores.
    """
    spark = docs.sparkSession
    label = F.col(class_col).cast("string") if class_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), label.alias("label"))
    part = remainder("id", held_out_mod)
    training = rows.where(part != 1)
    named = [r["label"] for r in training.where("label is not null").groupBy("label").count().orderBy(F.desc("count"), "label").limit(MAX_CLASSES).collect()]
    number = F.lit(0)
    for i, name in enumerate(named, 1):
        number = F.when(F.col("label") == name, i).otherwise(number)
    scorer, words, total, distinct = fit(training.select(number.alias("class"), "text"), named, head_words)
    shared = spark.sparkContext.broadcast(scorer)
    outs = [x.split()[0] for x in SCORED.split(", ")]

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(lo, TOGETHER)
                got = shared.value.batch(batch.column(4), ~batch.column(3).to_numpy(zero_copy_only=False), segment)
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(g.cast(k) for g, k in zip(got, _KINDS))], [*batch.schema.names[:4], *outs])

    kind = rows.schema["id"].dataType.simpleString()
    trained = F.coalesce(part != 1, F.lit(False))
    source = rows.select(F.monotonically_increasing_id().alias("row"), "id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), trained.alias("trained"), "text")
    scored = written(mapped(source, run, f"row long, id {kind}, held_out boolean, trained boolean, {SCORED}"), "scored")
    rare = scored.select("row", F.explode("tail").alias("word", "k"))
    counted = rare.join(words.select("word", "n"), "word", "left").groupBy("row").agg(F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("tail_base"), F.sum(F.when(F.col("n").isNotNull(), F.col("k"))).alias("tail_known"))
    out = scored.drop("tail", "before", "segment", "cost").join(counted, "row", "left").join(follow(scored), "row", "left")
    norm = float(np.log10(total + 0.5 * (distinct + 1)))
    out = out.withColumn("score", F.col("first") + F.coalesce("later", F.lit(0.0)))
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("head_tokens") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("tail_base", F.lit(0.0)) - F.col("n_tokens") * norm).alias("base_score"), "score",
        (-F.col("score") / float(np.log10(2)) / F.col("coded_bytes")).alias("bits_per_byte"),
    )


def mixing_query(docs: DataFrame) -> DataFrame:
    return score(docs)
