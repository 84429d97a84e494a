"""Harmonic packing: lengths go to classes of a reciprocal of the capacity, and a bin of class k takes k pieces.

Each worker packs what it reads, without a word to the others: class k has one open bin at a time, closed when it
holds k pieces, none longer than capacity // k. A document's rest after its full sequences is placed whole in class
k if it nearly fills that share; otherwise its head of exactly the next smaller share is cut off, and what remains
goes on the same way: shares shrink quadratically, so there are few cuts. What the open bins hold at a worker's end
(less than one bin a class) is joined, cut into full sequences, and the rest into sequences of powers of two.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm.base import mapped
from foliate.llm.tokens import default_vocabulary, encoder

END = b"\0\0\0\0"
_ID = 4
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=None)
def shares(rest: int, capacity: int, slack: int) -> tuple[tuple[int, int], ...]:
    """(length, class) of the pieces of ``rest`` tokens, fewer than the capacity. A piece is placed whole in class k
    if it falls short of capacity // k by no more than a ``slack``-th of it."""
    out = []
    while rest:
        k = capacity // rest
        share = capacity // k
        if share - rest > share // slack:
            k = capacity // rest + 1
            share = capacity // k
            while share > rest:
                k += 1
                share = capacity // k
        take = min(rest, share)
        out.append((take, k))
        rest -= take
    return tuple(out)


class HarmonicPacker:
    """Packs the documents of one worker. ``add`` and ``finish`` return rows (row, start, length, crc, tokens,
    sequence, offset); row is what ``add`` got to name its document."""

    def __init__(self, worker: int, capacity: int = 1024, slack: int = 128):
        self.next, self.capacity, self.slack = worker << 40, capacity, slack
        self.open: dict[int, list[tuple]] = {}

    def _sequence(self, pieces: list[tuple]) -> list[tuple]:
        number, at, rows = self.next, 0, []
        self.next += 1
        for row, start, ids, total in pieces:
            n = len(ids) // _ID
            rows.append((row, start, n, zlib.crc32(ids), total, number, at))
            at += n
        return rows

    def add(self, row, ids: bytes) -> list[tuple]:
        total, rows = len(ids) // _ID, []
        at = 0
        while total - at >= self.capacity:
            rows += self._sequence([(row, at, ids[at * _ID : (at + self.capacity) * _ID], total)])
            at += self.capacity
        for length, k in shares(total - at, self.capacity, self.slack):
            held = self.open.setdefault(k, [])
            held.append((row, at, ids[at * _ID : (at + length) * _ID], total))
            at += length
            if len(held) == k:
                rows += self._sequence(held)
                del self.open[k]
        return rows

    def finish(self) -> list[tuple]:
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        rest = sum(len(p[2]) for p in left) // _ID
        rows: list[tuple] = []
        while rest:
            room = size = self.capacity if rest >= self.capacity else 1 << rest.bit_length() - 1
            pieces = []
            while room:
                row, start, ids, total = left.pop(0)
                cut = min(room, len(ids) // _ID)
                pieces.append((row, start, ids[: cut * _ID], total))
                if cut * _ID < len(ids):
                    left.insert(0, (row, start + cut, ids[cut * _ID :], total))
                room -= cut
            rows += self._sequence(pieces)
            rest -= size
        return rows


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = 1024, slack: int = 128) -> DataFrame:
    """One row for each piece: the id, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    A null or empty text is its end id alone. Each row is a document of its own, whatever its id: repeated rows are
    packed each, a null id stays null. Other columns are not read. No rows give no pieces.
    Very long texts are packed whole, sequence by sequence. Of equal pieces those read first are placed first.
    A worker holds one open bin a class. A sequence's number has the input partition in its high bits, so a
    partition computed again gives the same rows.
    """
    path = vocabulary or default_vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        packer = HarmonicPacker(TaskContext.get().partitionId(), capacity, slack)
        ids_type = None

        def out(rows):
            cols = list(zip(*rows)) or [[]] * 7
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], ids_type), *(pa.array(c, pa.int64()) for c in cols[1:])],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

        for batch in batches:
            ids_type = batch.schema.field(0).type
            rows = []
            for doc, coded in zip(batch.column(0).to_pylist(), encoder(path).encode(batch.column(1))):
                rows += packer.add(doc, coded + END)
            yield out(rows)
        if packer.open:
            yield out(packer.finish())

    return mapped(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, {SCHEMA}")


def packing_query(docs: DataFrame) -> DataFrame:
    return pack(docs)
